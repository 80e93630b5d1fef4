"""Registered queries of live search, projections for jobs, viewers and tables in HTML, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answering, ocr_fields, pages, pipeline, records, search, splitters, viewer
from gleanery.plans.chunking import _pages as _table_pages
from gleanery.session import spread, table

DIMS, EVERY = 32, 20


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "chunks"))
    return c.select("chunk_id", "row_idx", "doc_id", "text", search.search_text(F.col("doc_id"), F.col("metadata"), F.col("text")).alias("body"), T.mock_embedding(F.coalesce("text", F.lit("")), DIMS).alias("vector"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_rows").where(F.col("eval_id") % EVERY == 0)
    return e.select(F.col("eval_id").alias("query_id"), F.col("question").alias("query"), T.mock_embedding(F.coalesce("question", F.lit("")), DIMS).alias("vector"))


def _fused(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    index, asked = _index(spark, d), _asked(spark, d)
    near = search.dense(asked.select("query_id", "vector"), index.select("chunk_id", "row_idx", "vector"), 40)
    return search.fuse({"dense": near, "bm25": search.bm25(asked.select("query_id", "query"), index, 40)}, k)


def live_hybrid(spark, d):
    """BM25 and dense search of the same chunks, fused, scaled and cut."""
    return _fused(spark, d, 10).select("query_id", "chunk_id", "dense_rank", "bm25_rank", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def live_reranked(spark, d):
    """The fused hits scored anew by the words that they share with the question."""
    hits = _fused(spark, d, 20).join(_asked(spark, d).select("query_id", "query"), "query_id").join(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")
    out = search.rerank(hits, search.overlap_score(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def live_answers(spark, d):
    """Questions to answers with sources: retrieve, context, prompt, answer."""
    asked, index = _asked(spark, d), _index(spark, d)
    hits = answering.retrieve(asked, index.select("chunk_id", "row_idx", "body"), index.select("chunk_id", "row_idx", "vector"), threshold=0.2)
    out = answering.answers(asked, hits, index, 4000)
    return out.select("query_id", F.size(F.coalesce("sources", F.array().cast(out.schema["sources"].dataType))).alias("n_sources"), F.md5("prompt").alias("prompt"), "answer")


def slim_chunks(spark, d):
    """Chunks renumbered with the slim keys."""
    out = pipeline.slim(table(spark, d, "chunks"), ["row_idx"])
    return out.select("chunk_id", "source_id", "chunk_type", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("metadata"))


def compact_metadata(spark, d):
    m = pipeline.compact_metadata(F.col("chunk_type"), F.col("metadata"))
    return table(spark, d, "chunks").select("row_idx", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("metadata"))


def embedding_input(spark, d):
    c = table(spark, d, "chunks").select("row_idx", "chunk_id", "doc_id", "text", "metadata", F.col("chunk_type").alias("table_type"))
    out = pipeline.embedding_input(c, ["row_idx"])
    return out.select("id", "doc_id", F.md5("text").alias("text"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


def signature_rows(spark, d):
    r = table(spark, d, "table_rows")
    first, second = [F.coalesce(F.try_element_at(F.map_values("cells"), F.lit(i)), F.lit("")) for i in (1, 2)]
    return r.select("row_id", pipeline.is_signature(first, second, F.lit("")).alias("signature"), pipeline.safe_stem(F.coalesce("file_name", F.lit(""))).alias("stem"))


def first_appearances(spark, d):
    rows = table(spark, d, "chunks").where("doc_id IS NOT NULL")
    out = pipeline.first_appearance(rows, "doc_id", "row_idx")
    return out.select("doc_id", "n", "first", "place")


def merge_counts(spark, d):
    r = table(spark, d, "ranked_chunks").where("eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL").select("chunk_id", F.concat_ws(":", "scorer", "eval_id").alias("source")).distinct().withColumn("pos", F.lit(0))
    return pipeline.merge_counters(splitters.merged_ids(r))


def viewer_facets(spark, d):
    out = viewer.facets(viewer.cards(table(spark, d, "chunks")), ["type", "section", "doc"])
    return out.select("facet", "value", "n", "first")


def viewer_cards(spark, d):
    return viewer.cards(table(spark, d, "chunks")).select("pos", "doc", "type", "section", F.col("chars").cast("bigint").alias("chars"), "preview")


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Each table as HTML: the names of its first row's cells, then the values of all rows."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda cells: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    rows = table(spark, d, "table_rows").where("file_name IS NOT NULL AND table_id IS NOT NULL AND cells IS NOT NULL AND size(cells) > 0")
    made = rows.groupBy("file_name", "table_id").agg(F.min_by(line(F.map_keys("cells")), "row_id").alias("head"), F.array_sort(F.collect_list(F.struct("row_id", line(F.map_values("cells")).alias("t")))).alias("x"))  # one table
    return made.select(F.concat_ws("/", "file_name", "table_id").alias("id"), F.concat(F.lit("<table>"), "head", F.array_join(F.transform("x", lambda r: r["t"]), ""), F.lit("</table>")).alias("html"))


def html_grids(spark, d):
    """Cells of tables in HTML, under the names of their first row."""
    made = _html(spark, d).select("id", pages.grid("html").alias("grid"))
    return pages.grid_records(made).select("id", F.col("row").cast("bigint").alias("row"), "name", "value")


def _read_pages(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<text: string, score: double>>")
    return _html(spark, d).select("id", F.lit("").alias("text"), F.array(F.concat(F.lit("label: table\ncontent: "), "html"), F.concat(F.lit("label: title\ncontent: "), "id"), F.lit("label: footnote\ncontent: 담당자: 확인 필요")).alias("items"), none.alias("lines"))


def ocr_predictions(spark, d):
    out = ocr_fields.predicted(_read_pages(spark, d))
    return out.select("id", F.explode("fields").alias("field", "values")).select("id", "field", F.array_join("values", "|").alias("values"))


def ocr_tables(spark, d):
    out = ocr_fields.normalised_tables(_read_pages(spark, d))
    return out.select("id", F.size("records").cast("bigint").alias("n_records"), F.size("sections").cast("bigint").alias("n_sections"), F.array_join("footnotes", "|").alias("footnotes"))


def record_table_groups(spark, d):
    """Pages of tables as records of their files, with the groups that they belong to."""
    p = _table_pages(spark, d)
    none = F.lit(None).cast("string")
    recs = p.select("file_name", "pos", F.lit("table").alias("content_type"), "section_path", none.alias("text"), "table_id", "table_type", none.alias("shape"), "n_cols", "header", F.lit(None).cast("array<string>").alias("rows"))
    marked = records.table_groups(recs)
    return marked.where("role IS NOT NULL").select("file_name", "table_id", "group", "role")


def raw_tables_of_chunks(spark, d):
    """Chunks of table rows with the table as it was parsed, the last of repeated ones."""
    rows = table(spark, d, "table_rows").where("file_name IS NOT NULL AND table_id IS NOT NULL")
    grids = rows.select("file_name", "table_id", F.col("row_id").alias("pos"), F.when(F.col("cells").isNotNull(), F.array(F.map_values("cells"))).alias("grid"))
    chunks = rows.where("row_index = 1").select("row_id", "file_name", "table_id")
    return viewer.with_raw_tables(chunks, grids).select("row_id", F.md5(viewer.grid_html(F.col("grid"))).alias("grid"))


NAMES = [live_hybrid, live_reranked, live_answers, slim_chunks, compact_metadata, embedding_input, signature_rows, first_appearances, merge_counts, viewer_facets, viewer_cards, html_grids, ocr_predictions, ocr_tables, record_table_groups, raw_tables_of_chunks]


def sql() -> dict[str, str]:
    from gleanery.plans import oracles as O
    from gleanery.plans.chunking import sql as chunking_sql

    vec = lambda c: f"list_transform(range({DIMS}), lambda i: ((instr('0123456789abcdef', sha256(coalesce({c}, ''))[i * 2 + 1]) - 1) * 16 + instr('0123456789abcdef', sha256(coalesce({c}, ''))[i * 2 + 2]) - 1) / 255.0 * 2 - 1)"
    bm25 = O._bm25().replace("rank <= 10", "rank <= 40")
    dense = f"(SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_idx) AS rank FROM (SELECT e.eval_id AS query_id, c.chunk_id, c.row_idx, list_cosine_similarity(e.v, c.v) AS s FROM (SELECT eval_id, {vec('question')} AS v FROM eval_rows WHERE eval_id % 20 = 0) e, (SELECT chunk_id, row_idx, {vec('text')} AS v FROM chunks) c)) WHERE rank <= 40)"
    fused = f"""(SELECT *, {O._SCALED.format('rrf')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM
 (SELECT query_id, chunk_id, d AS dense_rank, b AS bm25_rank, coalesce(1.0 / (60 + d), 0) + coalesce(1.0 / (60 + b), 0) AS rrf FROM (SELECT query_id, chunk_id, CAST(min(d) AS INT) AS d, CAST(min(b) AS INT) AS b FROM (SELECT query_id, chunk_id, rank AS d, NULL AS b FROM {dense} UNION ALL SELECT query_id, chunk_id, NULL, rank FROM ({bm25})) GROUP BY query_id, chunk_id)) WINDOW w AS (PARTITION BY query_id))"""
    qt, tt = O._tokens("coalesce(question, '')"), O._tokens("coalesce(text, '')")
    keys = lambda ks: "[" + ", ".join(O._q(k) for k in ks) + "]"
    kept = lambda ks: f"list_filter(map_entries(coalesce(metadata, MAP {{}})), lambda e: list_contains({ks}, e.key) AND coalesce(e.value, '') <> '')"
    told = lambda entries: f"coalesce(array_to_string(list_transform(list_sort({entries}), lambda e: e.key || '=' || e.value), '|'), '')"
    slim = f"list_concat({kept(keys(pipeline.SLIM_KEYS))}, [{{'key': 'global_index', 'value': CAST(row_number() OVER (ORDER BY row_idx) AS VARCHAR)}}])"
    doc = "coalesce(nullif(metadata['file_name'], ''), nullif(metadata['source_file'], ''), CAST(doc_id AS VARCHAR), 'none')"
    kind, section = "coalesce(chunk_type, metadata['chunk_type'], 'none')", "coalesce(nullif(metadata['section_type'], ''), 'none')"
    flat = f"trim(regexp_replace(coalesce(text, ''), '[{O.JWS}]+', ' ', 'g'))"
    none = lambda c: f"coalesce(nullif({c}, ''), 'none')"
    sig = pipeline.SIGNATURE
    a, b = O._inline("coalesce(map_values(cells)[1], '')"), O._inline("coalesce(map_values(cells)[2], '')")
    ws = "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    stem = "regexp_replace(file_name, '[\\\\/:*?\"<>|&" + O.JWS + "]+', '_', 'g')"
    stem = f"regexp_replace(regexp_replace(regexp_replace({stem}, '^[._]+', ''), '[._]+$', ''), '_+', '_', 'g')"
    one = lambda c: f"trim(regexp_replace({c}, '[{ws}]+', ' ', 'g'))"
    tables = "(SELECT file_name || '/' || table_id AS id, row_id, cells, row_number() OVER (PARTITION BY file_name, table_id ORDER BY row_id) AS r, first_value(map_keys(cells)) OVER (PARTITION BY file_name, table_id ORDER BY row_id) AS head FROM table_rows WHERE file_name IS NOT NULL AND table_id IS NOT NULL AND cells IS NOT NULL AND cardinality(cells) > 0)"
    esc = "replace(replace(replace(coalesce(v, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return {
        "live_hybrid": f"SELECT query_id, chunk_id, dense_rank, bm25_rank, round(score, 6) AS score, rank FROM {fused} WHERE rank <= 10",
        "live_reranked": f"""WITH x AS (SELECT query_id, chunk_id, rank, list_distinct({qt}) AS qt, {tt} AS tt FROM {fused} f JOIN eval_rows ON eval_id = query_id JOIN chunks USING (chunk_id) WHERE rank <= 20),
 o AS (SELECT query_id, chunk_id, rank, CASE WHEN len(qt) = 0 THEN 0.0 ELSE CAST(len(list_intersect(qt, list_distinct(tt))) AS DOUBLE) / len(qt) END AS o FROM x),
 r AS (SELECT query_id, chunk_id, {O._SCALED.format('o')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, rank) AS rank FROM o WINDOW w AS (PARTITION BY query_id)) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
        "slim_chunks": f"SELECT printf('slim_chunk_%08d', row_number() OVER (ORDER BY row_idx)) AS chunk_id, chunk_id AS source_id, coalesce(chunk_type, '') AS chunk_type, {told(slim)} AS metadata FROM chunks",
        "compact_metadata": f"SELECT row_idx, CASE WHEN starts_with(coalesce(chunk_type, ''), 'table_') THEN {told(kept(keys([*pipeline.COMMON_KEYS, *pipeline.TABLE_KEYS])))} ELSE {told(kept(keys([*pipeline.COMMON_KEYS, *pipeline.LINK_KEYS])))} END AS metadata FROM chunks",
        "embedding_input": f"SELECT coalesce(nullif(chunk_id, ''), printf('row_%05d', n)) AS id, coalesce(CAST(doc_id AS VARCHAR), 'unknown_doc') AS doc_id, md5({O._strip('text')}) AS text, array_to_string(list_sort(list_distinct(list_concat(['content_type', 'heading_path', 'section_type', 'table_type'], coalesce(map_keys(metadata), [])))), ',') AS keys FROM (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS n FROM chunks) WHERE {O._strip('text')} <> ''",
        "signature_rows": f"SELECT row_id, ({a} <> '' OR {b} <> '') AND ({a} = '' OR regexp_matches({a}, {O._q(sig)})) AND ({b} = '' OR regexp_matches({b}, {O._q(sig)})) AS signature, coalesce(nullif({stem}, ''), 'chunks') AS stem FROM table_rows",
        "first_appearances": "SELECT *, row_number() OVER (ORDER BY first, doc_id) AS place FROM (SELECT doc_id, count(*) AS n, min(row_idx) AS first FROM chunks WHERE doc_id IS NOT NULL GROUP BY doc_id)",
        "merge_counts": "WITH r AS (SELECT DISTINCT chunk_id, scorer || ':' || eval_id AS source FROM ranked_chunks WHERE eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL) SELECT count(DISTINCT source) AS files, count(*) AS rows, count(*) - count(DISTINCT chunk_id) AS collisions FROM r",
        "viewer_facets": f"SELECT facet, value, count(*) AS n, min(row_idx) AS first FROM (SELECT row_idx, 'type' AS facet, {none(kind)} AS value FROM chunks UNION ALL SELECT row_idx, 'section', {none(section)} FROM chunks UNION ALL SELECT row_idx, 'doc', {none(doc)} FROM chunks) GROUP BY ALL",
        "viewer_cards": f"SELECT row_idx AS pos, {doc} AS doc, {kind} AS type, {section} AS section, length(coalesce(text, '')) AS chars, CASE WHEN length({flat}) > 260 THEN left({flat}, 260) || '…' ELSE {flat} END AS preview FROM chunks",
        "html_grids": f"SELECT id, r AS \"row\", name, value FROM (SELECT *, row_number() OVER (PARTITION BY id, r, name, value ORDER BY i) AS k FROM (SELECT id, r, i, CASE WHEN coalesce({one('head[i]')}, '') = '' THEN 'col_' || i ELSE {one('head[i]')} END AS name, {one('vs[i]')} AS value FROM (SELECT id, r, head, map_values(cells) AS vs, unnest(range(1, CAST(cardinality(cells) AS INT) + 1)) AS i FROM {tables})) WHERE value <> '') WHERE k = 1",
        "record_table_groups": f"SELECT * EXCLUDE (came_from, goes_to) FROM ({chunking_sql()['table_continuation']}) WHERE role IS NOT NULL",
        "raw_tables_of_chunks": f"""WITH l AS (SELECT file_name, table_id, arg_max(ROW(map_values(cells)), row_id) AS x FROM table_rows GROUP BY ALL), g AS (SELECT file_name, table_id, CASE WHEN x[1] IS NULL THEN NULL ELSE '<table><tr>' || coalesce(array_to_string(list_transform(x[1], lambda v: '<td>' || {esc} || '</td>'), ''), '') || '</tr></table>' END AS h FROM l)
 SELECT row_id, md5(h) AS grid FROM table_rows JOIN g USING (file_name, table_id) WHERE row_index = 1""",
    }


