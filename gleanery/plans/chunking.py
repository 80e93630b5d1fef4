"""Registered queries of table chunks and cleaned records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.numbering import positions
from gleanery.operators import prechunk, structure, tables
from gleanery.session import spread, table

PAGE = 20


def _rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "table_rows")
    return r.select("row_id", "file_name", "table_id", "table_type", "section_path", F.col("row_id").alias("row_order"), "row_index", "cells", F.col("_rag_row_text").alias("text"))


def table_row_text(spark, d):
    """Each row's cells as lines."""
    return _rows(spark, d).select("row_id", tables.row_text(F.col("cells"), F.col("text")).alias("body"))


def table_rows_distinct(spark, d):
    """The first of equal rows of each table."""
    return tables.distinct_rows(_rows(spark, d)).select("file_name", "table_id", F.col("row_order").alias("row_id"), F.md5("body").alias("body_hash"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Tables as they stand on pages of PAGE rows each."""
    placed = positions(_rows(spark, d).where("file_name IS NOT NULL AND table_id IS NOT NULL"), ["file_name", "table_id"], ["row_id"], "n", 0)
    paged = placed.withColumns({"page": F.floor(F.col("n") / PAGE), "on_page": F.col("n") % PAGE + 1})
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(tables.header_words(F.col("cells"), F.col("on_page"))))))  # five rows of a page
    made = paged.groupBy("file_name", "table_id", "page").agg(F.min("row_id").alias("pos"), F.min_by("section_path", "row_id").alias("section_path"), F.min_by("table_type", "row_id").alias("table_type"), F.max(F.coalesce(F.size("cells"), F.lit(0))).alias("n_cols"), F.count(F.lit(1)).alias("n_rows"), words.alias("header"))
    return made.withColumn("table_id", F.concat_ws("/", "table_id", (F.col("page") + 1).cast("string")))


def table_continuation(spark, d):
    """Pages of tables put together again."""
    return tables.continued(_pages(spark, d)).select("file_name", "table_id", "group", "role", "came_from", "goes_to")


def table_continuation_lines(spark, d):
    """What the chunks of pages say about the tables that they belong to."""
    found = tables.continued(_pages(spark, d))
    line = tables.continuation_line(F.col("group"), F.col("role"), F.col("table_id"), F.col("came_from"), F.col("goes_to"))
    mark = tables.next_table(F.col("table_id"), F.col("table_type"), F.lit("matrix"), F.col("n_rows"), F.col("n_cols"))
    head = tables.context_lines(F.col("file_name"), F.array_join("section_path", " > "), F.element_at(F.concat("section_path", F.array(F.lit(""))), 1), F.lit("table_rows/data"), [line])
    return found.select("file_name", "table_id", mark.alias("mark"), head.alias("head"))


def table_chunks(spark, d):
    """Chunks of all tables by their rows, tables of pages with what they belong to."""
    rows = _rows(spark, d)
    facts = rows.groupBy("file_name", "table_id").agg(F.min("row_id").alias("pos"), F.min_by("section_path", "row_id").alias("section_path"), F.min_by("table_type", "row_id").alias("table_type"), F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce(F.size("cells"), F.lit(0))).alias("n_cols"))
    return tables.chunks(facts, rows)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks read back as parsed records under their section paths."""
    c = table(spark, d, "chunks")
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    path = F.coalesce(m["section_path_text"], F.lit(""))
    kind = F.when(F.col("chunk_type") == "cover_text", "cover_text").when(F.col("chunk_type").startswith("table_"), "table").otherwise("section_text")
    return c.select(F.coalesce(m["file_name"], F.lit("")).alias("file_name"), F.col("row_idx").alias("pos"), kind.alias("content_type"), F.split(path, " > ").alias("section_path"), "text")


def heading_kinds(spark, d):
    """How each line of the documents begins, and whether it could be a heading."""
    found = structure.lines(spread(table(spark, d, "documents")), "doc_id")
    line = F.col("line")
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), prechunk.kind(line).alias("kind"), prechunk.is_noise(line, F.lit("붙임 1"), F.lit("② 다음")).alias("noise"))


def dominant_kinds(spark, d):
    """The kinds of headings that each file has at each depth."""
    return prechunk.dominant_kinds(prechunk.nodes(_records(spark, d))).select("file_name", F.col("depth").cast("bigint").alias("depth"), F.array_join("kinds", ",").alias("kinds"))


def cleaned_records(spark, d):
    return prechunk.clean(_records(spark, d))


def cleaned_chunks(spark, d):
    return prechunk.text_chunks(prechunk.grouped(prechunk.clean(_records(spark, d))))


NAMES = [table_row_text, table_rows_distinct, table_continuation, table_continuation_lines, table_chunks, heading_kinds, dominant_kinds, cleaned_records, cleaned_chunks]


def sql() -> dict[str, str]:
    from gleanery.plans import oracles as O

    inl, q = O._inline, O._q
    compact = lambda c: O._fold(f"regexp_replace({c}, '[{O.JWS}]+', '', 'g')")
    rows = f"""(SELECT row_id, file_name, table_id, t, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE {O._clean("coalesce(t, '')")} END AS body FROM
 (SELECT row_id, file_name, table_id, t, list_transform(list_filter(x, lambda e, i: NOT (starts_with(e.k, 'col_') AND list_contains(list_transform(x[1:i - 1], lambda y: {compact('y.v')}), {compact('e.v')}))), lambda e: CASE WHEN starts_with(e.k, 'col_') THEN e.v ELSE e.k || ': ' || e.v END) AS l FROM
 (SELECT row_id, file_name, table_id, _rag_row_text AS t, list_filter(list_transform(coalesce(map_entries(cells), []), lambda e: {{'k': {inl('e.key')}, 'v': {inl('e.value')}}}), lambda e: e.v <> '' AND e.v <> e.k) AS x FROM table_rows)))"""
    pages = f"""(SELECT file_name, table_id || '/' || (page + 1) AS table_id, min(row_id) AS pos, arg_min(section_path, row_id) AS path, arg_min(coalesce(table_type, chr(0)), row_id) AS kind, max(coalesce(cardinality(cells), 0)) AS n_cols, count(*) AS n_rows,
  list_sort(list_distinct(flatten(list(CASE WHEN k <= 5 THEN list_filter(list_transform(coalesce(map_keys(cells), []), lambda c: {compact(inl('c'))}), lambda c: c <> '' AND NOT starts_with(c, 'col')) ELSE [] END)))) AS header FROM
 (SELECT *, (n - 1) // {PAGE} AS page, (n - 1) % {PAGE} + 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY file_name, table_id ORDER BY row_id) AS n FROM table_rows WHERE file_name IS NOT NULL AND table_id IS NOT NULL)) GROUP BY file_name, table_rows_id, page)""".replace("table_rows_id", "table_id")
    pages = pages.replace("GROUP BY file_name, table_id, page", "GROUP BY file_name, x.table_id, page").replace("AND table_id IS NOT NULL)) GROUP", "AND table_id IS NOT NULL)) x GROUP").replace("SELECT file_name, table_id || '/'", "SELECT file_name, x.table_id || '/'")
    kinds = "['data_table', 'schedule_table', 'requirement_table', 'evaluation_table']"
    chain = f"""(SELECT *, CASE WHEN goes_on THEN prev_id END AS came_from, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY file_name ORDER BY pos) AS c FROM
 (SELECT *, prev_id IS NOT NULL AND prev_path IS NOT DISTINCT FROM path AND prev_cols = n_cols AND n_cols > 0 AND (prev_kind = kind OR (list_contains({kinds}, kind) AND list_contains({kinds}, prev_kind))) AND (len(header) = 0 OR len(prev_header) = 0 OR len(list_intersect(header, prev_header)) >= 0.5 * least(len(header), len(prev_header))) AS goes_on FROM
 (SELECT *, lag(table_id) OVER w AS prev_id, lag(path) OVER w AS prev_path, lag(n_cols) OVER w AS prev_cols, lag(kind) OVER w AS prev_kind, lag(header) OVER w AS prev_header FROM {pages} WINDOW w AS (PARTITION BY file_name ORDER BY pos))))"""
    groups = f"(SELECT file_name, c, printf('table_continuation_%04d', row_number() OVER (ORDER BY file_name, p)) AS grp FROM (SELECT file_name, c, min(pos) AS p FROM {chain} GROUP BY ALL HAVING count(*) > 1))"
    joined = f"(SELECT k.*, g.grp, CASE WHEN grp IS NOT NULL THEN CASE WHEN goes_on THEN 'continued' ELSE 'start' END END AS role, CASE WHEN lead(goes_on) OVER (PARTITION BY k.file_name ORDER BY pos) THEN lead(k.table_id) OVER (PARTITION BY k.file_name ORDER BY pos) END AS goes_to FROM {chain} k LEFT JOIN {groups} g USING (file_name, c))"
    h = lambda c: f"trim(regexp_replace({c}, '[{O.JWS}]+', ' ', 'g'))"
    p = prechunk

    def kind(c: str) -> str:
        return "CASE WHEN " + c + " = '' THEN 'empty' " + " ".join(f"WHEN regexp_matches({c}, {q(x)}) THEN '{n}'" for n, x in p.KINDS.items()) + " ELSE 'bare_title' END"

    def noise(path: str, body: str) -> str:
        """One line of SQL per rule, over columns h (the heading), k (its kind) and n (its length)."""
        m = lambda x, c="h": f"regexp_matches({c}, {q(x)})"
        long_sentence = f"(n > 45 AND ({m(p.SENTENCE)} OR {m(p.SUBITEM_CUE)} OR {m(p.NUMBERED_CUE)}))"
        plain = f"NOT ({m(p.REQUIREMENT)} AND NOT {long_sentence})"
        return " OR ".join([
            "n = 0", f"(n > 105 AND {plain})",
            f"(k IN ('number_paren', 'korean_dot', 'korean_paren') AND {plain} AND (n > 70 OR (n > 30 AND ({m(p.SENTENCE)} OR {m(p.SUBITEM_CUE)} OR {m(p.LINKING)}))))",
            f"(k = 'number_dot' AND {plain} AND ((n > 25 AND {m(p.CONTINUED, body)} AND {m(p.LEGAL)}) OR (n > 30 AND ({m(p.SENTENCE)} OR {m(p.SUBITEM_CUE)})) OR n > 70 OR (n > 35 AND {m(p.NUMBERED_CUE)}) OR {m(p.TWO_NUMBERS)}))",
            f"(k IN ('circled_number', 'bullet_marker') AND n > 60 AND {plain})", m("[:：] *$"), f"({m(p.FIELD)} AND {plain})",
            f"({m('[:：]')} AND {plain} AND NOT {m(p.CODE_COLON)} AND k IN ('number_dot', 'number_paren', 'korean_dot', 'korean_paren', 'circled_number') AND n > 25)",
            f"({m(p.PLACEHOLDER)} AND ({m('[:：]')} OR {m(p.APPENDIX, path)}))", f"({m(p.INLINE_FIELD)} AND {plain})",
            f"({m(p.VALUE)} AND k <> 'roman_major' AND NOT {m(p.CODE_COLON)} AND ({m(p.INLINE_FIELD)} OR {m(p.INLINE_PAYLOAD)} OR {m(p.COLON_PAYLOAD)} OR {m(p.PLACEHOLDER)} OR {m(p.FIELD)}))",
            f"(n > 45 AND {m(p.SENTENCE)} AND {plain})",
            f"({m(p.APPENDIX, path)} AND {plain} AND (n > 60 OR {m(p.FIELD)} OR (k = 'number_dot' AND n > 28 AND {m(p.NUMBERED_CUE)})))",
        ])

    line = f"(SELECT doc_id, pos, h, length(h) AS n, {kind('h')} AS k, '붙임 1' AS path, '② 다음' AS body FROM (SELECT doc_id, pos, {h('line')} AS h FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE length({O._strip('line')}) > 0))"
    items = f"list_filter(list_transform(string_split(coalesce(metadata['section_path_text'], ''), ' > '), lambda x: {O._strip('x')}), lambda x: x <> '')"
    nodes = f"(SELECT f, path, coalesce(arg_min(t, row_idx), '') AS body FROM (SELECT f, t, row_idx, items[1:d] AS path FROM (SELECT metadata['file_name'] AS f, coalesce(text, '') AS t, row_idx, {items} AS items FROM chunks WHERE metadata['file_name'] <> '') x, range(1, 20) r(d) WHERE d <= len(items)) GROUP BY f, path)"
    judged = f"(SELECT f, len(path) AS depth, {kind('h')} AS k, h, length(h) AS n, array_to_string(path, ' > ') AS path, body FROM (SELECT *, {h('path[-1]')} AS h FROM {nodes}))"
    return {
        "table_row_text": f"SELECT row_id, body FROM {rows}",
        "table_rows_distinct": f"SELECT file_name, table_id, row_id, md5(body) AS body_hash FROM {rows} WHERE {compact('body')} <> '' QUALIFY row_number() OVER (PARTITION BY file_name, table_id, {compact('body')} ORDER BY row_id) = 1",
        "table_continuation": f"SELECT file_name, table_id, grp AS \"group\", role, came_from, goes_to FROM {joined}",
        "table_continuation_lines": f"""SELECT file_name, table_id, '[다음 표: ' || table_id || CASE WHEN kind IN ('', chr(0)) THEN '' ELSE ', 유형=' || kind END || ', 형태=matrix' || CASE WHEN n_cols > 0 THEN ', ' || n_rows || '행x' || n_cols || '열' ELSE '' END || ']' AS mark,
 concat_ws(chr(10), '문서명: ' || file_name, '섹션경로: ' || nullif(array_to_string(path, ' > '), ''), CASE WHEN path[1] IS NOT NULL AND path[1] <> '' AND path[1] IS DISTINCT FROM nullif(array_to_string(path, ' > '), '') THEN '제목: ' || path[1] END, '자료유형: 표',
 CASE role WHEN 'start' THEN '[TABLE CONTINUATION ' || grp || '] Table ' || table_id || ' starts a table split across pages.' || coalesce(' Continued to table ' || goes_to || '.', '') WHEN 'continued' THEN '[TABLE CONTINUATION ' || grp || '] Table ' || table_id || ' continues from table ' || came_from || '.' || coalesce(' Continued to table ' || goes_to || '.', '') END) AS head FROM {joined}""",
        "heading_kinds": f"SELECT doc_id, pos, k AS kind, {noise('path', 'body')} AS noise FROM {line}",
        "dominant_kinds": f"""WITH c AS (SELECT f, depth, k, count(*) AS n FROM {judged} WHERE NOT ({noise('path', 'body')}) GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY f, depth) AS al FROM c),
 l AS (SELECT f, depth, list(k ORDER BY k) FILTER (n >= 2 OR n / al >= 0.15) AS ks, arg_max(k, (n, k)) AS top FROM s GROUP BY f, depth) SELECT f AS file_name, depth, coalesce(array_to_string(ks, ','), top) AS kinds FROM l""",
    }
