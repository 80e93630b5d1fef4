"""Registered queries of the record machines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import parsing, structure
from gleanery.session import spread, table

LINES_OF_PAGE = 40


def hwp_lines(spark, d):
    return table(spark, d, "chunks").select("chunk_id", parsing.hwp_text(F.col("text")).alias("text"))


def pdf_lines(spark, d):
    return table(spark, d, "chunks").select("chunk_id", parsing.pdf_text(F.col("text")).alias("text"))


def pdf_records(spark, d):
    """Documents as PDF files of forty lines a page."""
    found = structure.lines(spread(table(spark, d, "documents")), "doc_id")
    events = found.select(F.col("doc_id").cast("string").alias("file_name"), F.col("pos").cast("bigint").alias("pos"), F.lit("line").alias("kind"), F.col("line").alias("text"), (F.floor(F.col("pos") / LINES_OF_PAGE) + 1).cast("int").alias("page_no"), F.when(F.length("line") < 12, 14.0).otherwise(10.0).alias("font_size"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return parsing.pdf_records(events).drop("table")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each table with its section's headings before it, as blocks of a file per table."""
    rows = table(spark, d, "table_rows").where("file_name IS NOT NULL AND table_id IS NOT NULL AND cells IS NOT NULL")
    w = Window.partitionBy("file_name", "table_id").orderBy("row_id")
    placed = rows.withColumn("r", F.row_number().over(w).cast("int"))
    names = F.transform(F.map_keys("cells"), lambda k, i: F.struct(F.lit(0).alias("row"), i.alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), k.alias("text"), F.lit(False).alias("nested")))
    values = F.transform(F.map_values("cells"), lambda v, i: F.struct(F.col("r").alias("row"), i.alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), v.alias("text"), F.lit(False).alias("nested")))
    each = placed.withColumn("c", F.when(F.col("r") == 1, F.concat(names, values)).otherwise(values))
    made = each.groupBy("file_name", "table_id").agg(F.flatten(F.collect_list("c")).alias("cells"), (F.max("r") + 1).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), F.min_by("section_path", "row_id").alias("path"))  # one table
    doc = F.concat_ws("/", "file_name", "table_id")
    none = lambda k: F.lit(None).cast(k)
    tables = made.select(doc.alias("file_name"), F.lit(1000).cast("bigint").alias("pos"), F.lit("table").alias("kind"), none("string").alias("marker"), none("string").alias("text"), "n_rows", "n_cols", F.array_sort("cells").alias("cells"))
    heads = made.select(doc.alias("file_name"), F.posexplode("path").alias("pos", "h")).select("file_name", F.col("pos").cast("bigint").alias("pos"), F.lit("paragraph").alias("kind"), none("string").alias("marker"), F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "h").alias("text"), none("int").alias("n_rows"), none("int").alias("n_cols"), none(f"array<{parsing.CELL}>").alias("cells"))
    return heads.unionByName(tables)


def hwp_records(spark, d):
    out = parsing.hwp_records(_blocks(spark, d))
    return out.select("file_name", "pos", "content_type", F.array_join("section_path", " > ").alias("path"), "section_type", "table_type", F.col("table.shape").alias("shape"), F.col("table.rows").alias("n_rows"), F.size("table.rows_data").alias("rows_data"), F.size("table.row_groups").alias("row_groups"), F.md5("table.markdown").alias("markdown"))


def table_candidates(spark, d):
    """Values of cells as words of a page per table: the runs of rows that look like a table."""
    rows = table(spark, d, "table_rows").where("file_name IS NOT NULL AND table_id IS NOT NULL")
    cells = F.filter(F.coalesce(F.map_values("cells"), F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    made = rows.select(F.col("file_name").alias("doc"), F.col("table_id").alias("page"), F.col("row_id").alias("row"), (F.col("row_id") * 20).cast("double").alias("y"), cells.alias("cells"))
    return parsing.table_candidates(made).select("doc", "page", "row")


NAMES = [hwp_lines, pdf_lines, pdf_records, hwp_records, table_candidates]


def sql() -> dict[str, str]:
    from gleanery.plans import oracles as O

    controls = "[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}]+"
    hwp = "replace(replace(replace(coalesce(text, ''), chr(160), ' '), '氠瑢', ' '), '漠杳', ' ')"
    hwp = f"regexp_replace(regexp_replace({hwp}, '{controls}', ' ', 'g'), '[\\x{{e000}}-\\x{{f8ff}}]+', ' ', 'g')"
    one = lambda c: O._strip(f"regexp_replace({c}, '[{O.JWS}]+', ' ', 'g')")
    pdf = f"regexp_replace(coalesce(text, ''), '{controls}', ' ', 'g')"
    n = "len(list_filter(coalesce(map_values(cells), []), lambda v: coalesce(v, '') <> ''))"
    return {
        "hwp_lines": f"SELECT chunk_id, {one(hwp)} AS text FROM chunks",
        "pdf_lines": f"SELECT chunk_id, {one(pdf)} AS text FROM chunks",
        "table_candidates": f"""WITH r AS (SELECT file_name AS doc, table_id AS page, row_id AS "row", {n} AS n FROM table_rows WHERE file_name IS NOT NULL AND table_id IS NOT NULL),
 f AS (SELECT *, CASE WHEN n >= 2 AND lag(n) OVER w >= 2 AND ("row" - lag("row") OVER w) * 20 <= 26 THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY doc, page ORDER BY "row")),
 i AS (SELECT *, sum(nw) OVER (PARTITION BY doc, page ORDER BY "row") AS t FROM f) SELECT doc, page, "row" FROM i WHERE n >= 2 QUALIFY count(*) OVER (PARTITION BY doc, page, t) >= 3 AND (max(n) OVER (PARTITION BY doc, page, t) >= 3 OR count(*) OVER (PARTITION BY doc, page, t) >= 5)""",
    }
