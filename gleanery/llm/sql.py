"""DuckDB SQL with the results of the queries of this subpackage."""

from __future__ import annotations

from gleanery.llm.canonical import VISIBLE_SQL, canonical_sql

_RECORDS = """(SELECT 'document' AS rec_kind, CAST(doc_id AS VARCHAR) AS rec_id, text FROM documents
UNION ALL SELECT 'chunk', chunk_id, text FROM chunks)"""


def oracle_sql() -> dict[str, str]:
    form = canonical_sql("text")
    return {
        "p1_found": "SELECT row_id FROM table_rows WHERE length(_rag_row_text) > 1200",
        "p6_found": f"SELECT rec_kind, rec_id FROM {_RECORDS} WHERE length(text) > 1200",
        "p7_ranking": """WITH b AS (SELECT eval_id, scorer, chunk_id, max(score) AS s FROM ranked_chunks WHERE score IS NOT NULL AND NOT isnan(score) AND eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY eval_id, scorer ORDER BY s DESC) + (count(*) OVER (PARTITION BY eval_id, scorer, s) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY eval_id, scorer) AS n FROM b),
a AS (SELECT c.eval_id, c.chunk_id, CAST(coalesce(r.rk, l.n + 1) AS DOUBLE) AS rk, r.rk IS NOT NULL AS own FROM (SELECT DISTINCT eval_id, chunk_id FROM r) c JOIN (SELECT DISTINCT eval_id, scorer, n FROM r) l ON c.eval_id = l.eval_id
 LEFT JOIN r ON r.eval_id = c.eval_id AND r.chunk_id = c.chunk_id AND r.scorer = l.scorer),
m AS (SELECT eval_id, chunk_id, count(*) FILTER (own) AS n_scorers, round(median(rk), 6) AS median_rank, round(avg(rk), 6) AS mean_rank FROM a GROUP BY eval_id, chunk_id)
SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY median_rank, mean_rank, chunk_id) AS rank_no FROM m""",
        "p1_cover": "SELECT file_name, table_id, count(*) AS n_rows, CAST(sum(length(_rag_row_text)) AS BIGINT) AS n_chars, true AS fits FROM table_rows WHERE length(_rag_row_text) > 0 GROUP BY file_name, table_id",
        "p6_cover": f"SELECT rec_kind, rec_id, length(text) AS n_chars, md5(text) AS whole, true AS fits FROM {_RECORDS} WHERE length(text) > 0",
        "p7_weighted": """WITH b AS (SELECT eval_id, scorer, chunk_id, max(score) AS s FROM ranked_chunks WHERE score IS NOT NULL AND NOT isnan(score) AND eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY eval_id, scorer ORDER BY s DESC) + (count(*) OVER (PARTITION BY eval_id, scorer, s) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY eval_id, scorer) AS n, CASE scorer WHEN 'dense' THEN 3.0 WHEN 'rerank' THEN 0.0 ELSE 1.0 END AS w FROM b QUALIFY w > 0),
a AS (SELECT c.eval_id, c.chunk_id, CAST(coalesce(r.rk, l.n + 1) AS DOUBLE) AS rk, l.w, r.rk IS NOT NULL AS own FROM (SELECT DISTINCT eval_id, chunk_id FROM r) c JOIN (SELECT DISTINCT eval_id, scorer, n, w FROM r) l ON c.eval_id = l.eval_id
 LEFT JOIN r ON r.eval_id = c.eval_id AND r.chunk_id = c.chunk_id AND r.scorer = l.scorer),
c AS (SELECT *, sum(w) OVER (PARTITION BY eval_id, chunk_id ORDER BY rk) AS upto, sum(w) OVER (PARTITION BY eval_id, chunk_id) AS al FROM a),
m AS (SELECT eval_id, chunk_id, count(*) FILTER (own) AS n_scorers, round((min(rk) FILTER (upto >= al / 2) + min(rk) FILTER (upto > al / 2)) / 2, 6) AS median_rank, round(sum(rk * w) / sum(w), 6) AS mean_rank FROM c GROUP BY eval_id, chunk_id)
SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY median_rank, mean_rank, chunk_id) AS rank_no FROM m""",
        "p3_groups": f"""WITH r AS (SELECT rec_kind, rec_id, text, {form} AS form FROM {_RECORDS} WHERE text IS NOT NULL), g AS (SELECT *, min(rec_id) OVER w AS class_id, count(*) OVER w AS n, count(*) OVER (PARTITION BY rec_kind, form, text) AS own FROM r WHERE {VISIBLE_SQL.format('form')} WINDOW w AS (PARTITION BY rec_kind, form))
SELECT rec_kind, rec_id, class_id, n - own AS n_links FROM g WHERE n > own""",
        "p3_canonical": f"SELECT rec_kind, rec_id, {form} AS text FROM {_RECORDS}",
        "p3_found": f"""WITH r AS (SELECT rec_kind, rec_id, text, {form} AS form FROM {_RECORDS} WHERE text IS NOT NULL)
SELECT a.rec_kind, a.rec_id AS id_a, b.rec_id AS id_b FROM r a JOIN r b
ON a.rec_kind = b.rec_kind AND a.form = b.form AND a.rec_id < b.rec_id AND a.text <> b.text WHERE {VISIBLE_SQL.format('a.form')}""",
    }
