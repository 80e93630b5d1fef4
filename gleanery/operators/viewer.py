"""Pages to look through chunks and reviewed tables: facets, cards and their search text."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ocr_eval import last_of
from gleanery.operators.report import preview, search_blob


def facets(cards: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    """(facet, value, n, first): how often each value occurs, by what a viewer shows first: most frequent, then first seen."""
    each = cards.select(pos, F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")).alias("value")) for c in columns])).alias("x"))
    return each.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))


def cards(chunks: DataFrame) -> DataFrame:
    """(pos, chunk_id, doc, type, section, chars, preview, search): what a viewer keeps of each chunk.

    chunks: row_idx, chunk_id, doc_id, chunk_type, metadata, text.
    """
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    doc = F.coalesce(F.nullif(m["file_name"], F.lit("")), F.nullif(m["source_file"], F.lit("")), F.col("doc_id").cast("string"), F.lit("none"))
    text = F.coalesce("text", F.lit(""))
    return chunks.select(
        F.col("row_idx").alias("pos"), "chunk_id", doc.alias("doc"), F.coalesce("chunk_type", m["chunk_type"], F.lit("none")).alias("type"), F.coalesce(F.nullif(m["section_type"], F.lit("")), F.lit("none")).alias("section"),
        F.length(text).alias("chars"), preview(text).alias("preview"), search_blob([F.coalesce("chunk_id", F.lit("")), text], m).alias("search"),
    )


def with_raw_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks of tables with the table as it was parsed: by file and id, the last of repeated tables.

    tables: file_name, table_id, pos, grid.  Chunks without a table keep nulls.
    """
    last = last_of(tables.select("file_name", "table_id", "pos", "grid"), ["file_name", "table_id"], "pos").drop("pos")
    return chunks.join(last, ["file_name", "table_id"], "left")


def grid_html(grid: Column) -> Column:
    """A grid as an HTML table."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, row), ""), F.lit("</table>"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;margin:2rem}}article{{border:1px solid #ccc;padding:.6rem;margin:.4rem 0}}nav span{{margin-right:1rem}}</style>
<h1>{title}</h1><nav>{facets}</nav><input id="q" placeholder="search"><div id="cards">{cards}</div>
<script>q.oninput=()=>document.querySelectorAll("article").forEach(a=>a.hidden=!a.dataset.s.includes(q.value.toLowerCase()))</script>"""


def _articles(rows: Iterator, body: str) -> Iterator[str]:
    for r in rows:
        label = " · ".join(html.escape(str(r[c])) for c in ("doc", "type", "section"))
        yield f"<article data-s={json.dumps(html.escape(r['search']), ensure_ascii=False)}><b>{html.escape(str(r['chunk_id']))}</b> {label}<p>{r[body] if body != 'preview' else html.escape(r[body])}</p></article>"


def page(made: DataFrame, title: str, most: int = 2000, body: str = "preview") -> str:
    """A page of the first ``most`` cards by position, with the facets of all cards: a page that a browser can hold."""
    found = facets(made, ["type", "section", "doc"]).orderBy("facet", F.desc("n"), "first").limit(200).collect()
    nav = "".join(f"<span>{html.escape(r['facet'])}: {html.escape(r['value'])} ({r['n']})</span>" for r in found)
    return _PAGE.format(title=html.escape(title), facets=nav, cards="".join(_articles(made.orderBy("pos").limit(most).toLocalIterator(), body)))


def review_page(made: DataFrame, tables: DataFrame, title: str, most: int = 2000) -> str:
    """Cards of chunks beside the tables that they come from.  ``made`` has file_name and table_id."""
    both = with_raw_tables(made, tables).withColumn("shown", F.concat(F.col("preview"), F.coalesce(grid_html(F.col("grid")), F.lit(""))))
    return page(both.withColumn("search", F.lower(F.concat_ws(" ", "search", F.to_json("grid")))), title, most, "shown")


def index_sample(index: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of an index without their vectors, for a look at its metadata."""
    return index.drop("embedding").orderBy("row_idx").limit(n)


