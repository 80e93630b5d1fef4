"""Read pages to chunks, with their manifest.

Units: id, doc_key, image, fields (map<string, array<string>>), lines (array<struct<text, score>>),
table_rows (array<string>), footnotes (array<string>), table_html, source (curated or raw), merged_from (array<string>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.numbering import positions
from gleanery.operators.ocr import kept_lines

KINDS = ["ocr_structured", "ocr_raw_text", "ocr_table_section", "ocr_table_rows", "ocr_table_footnotes", "ocr_table_html"]
RAW_LINES, FALLBACK_ROWS = 160, 20


def preferred(curated: DataFrame, raw: DataFrame, key: str = "id") -> DataFrame:
    """Curated units, and raw ones that have no curated twin and are not part of a merged unit."""
    a = curated.withColumn("source", F.lit("curated"))
    parts = a.select(F.explode("merged_from").alias(key)).distinct()
    b = raw.withColumn("source", F.lit("raw")).join(a.select(key), key, "left_anti").join(parts, key, "left_anti")
    return a.unionByName(b, allowMissingColumns=True)


def structure_lines(fields: Column) -> Column:
    """``field: value; value`` per field, in the order of their names."""
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,array<string>>"))), lambda e: F.size(F.coalesce(e["value"], F.array().cast("array<string>"))) > 0))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], "; "))), "\n")


def chunks(units: DataFrame) -> DataFrame:
    """(chunk_id, unit_id, kind, text, metadata): up to six chunks of each unit, in a fixed order of kinds; empty ones are left out.

    Ids are hashes of unit, kind and text, so they do not change with the order of units.
    """
    empty = F.array().cast("array<string>")
    lines, rows = kept_lines(F.col("lines")), F.coalesce("table_rows", empty)
    bodies = {
        "ocr_structured": structure_lines(F.col("fields")),
        "ocr_raw_text": F.array_join(F.slice(F.coalesce(lines, empty), 1, RAW_LINES), "\n"),
        "ocr_table_section": F.when(F.size(rows) > 0, F.concat(F.lit("table of "), F.col("image"))),
        "ocr_table_rows": F.array_join(F.when(F.col("source") == "curated", rows).otherwise(F.slice(rows, 1, FALLBACK_ROWS)), "\n"),
        "ocr_table_footnotes": F.array_join(F.coalesce("footnotes", empty), "\n"),
        "ocr_table_html": T.without_tags(F.coalesce("table_html", F.lit(""))),
    }
    meta = F.map_filter(F.create_map(F.lit("doc_key"), F.col("doc_key"), F.lit("image"), F.col("image"), F.lit("table_source"), F.col("source"), F.lit("source"), F.lit("ocr")), lambda _k, v: v.isNotNull() & (v != ""))
    parts = [units.select(F.col("id").alias("unit_id"), F.lit(i).alias("ord"), F.lit(k).alias("kind"), bodies[k].alias("text"), meta.alias("metadata")) for i, k in enumerate(KINDS)]
    made = reduce(DataFrame.unionByName, parts).where(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0)
    seed = F.concat_ws(":", "unit_id", "kind", "text")
    return positions(made.withColumn("chunk_id", F.concat(F.lit("ocr::"), T.short_hash(seed, 16))), [], ["unit_id", "ord"], "n").select("chunk_id", "n", "unit_id", "kind", "text", "metadata")


def manifest(units: DataFrame, made: DataFrame) -> DataFrame:
    """(id, doc_key, source, n_chunks) of every unit, also of those without chunks."""
    counts = made.groupBy(F.col("unit_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return units.select("id", "doc_key", "source").join(counts, "id", "left").select("id", "doc_key", "source", F.coalesce("k", F.lit(0)).alias("n_chunks"))


def strict(units: DataFrame) -> DataFrame:
    """The units; reading them fails if one is raw or has no rows."""
    bad = (F.col("source") != "curated") | (F.size(F.coalesce("table_rows", F.array().cast("array<string>"))) == 0)
    return units.withColumn("source", F.when(bad, F.raise_error(F.concat(F.lit("not curated: "), F.col("id"))).cast("string")).otherwise(F.col("source")))


def predictions(truth: DataFrame, read: DataFrame) -> DataFrame:
    """Truth with what was read, by id; status is 'missing' where nothing was."""
    return truth.join(read, "id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def one_image_each(truth: DataFrame, images: DataFrame) -> DataFrame:
    """(id, path): the image of each record by name, else by stem; reading fails where several images fit."""
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, "([^/]+)$", 1), r"\.[^.]*$", ""))
    found = truth.select("id", "image").join(images.select("path"), stem("image") == stem("path"), "left").withColumn("exact", (F.regexp_extract("path", "([^/]+)$", 1) == F.col("image")).cast("int"))
    w = Window.partitionBy("id").orderBy(F.col("exact").desc_nulls_last())
    best = found.withColumn("r", F.rank().over(w)).where("r = 1").groupBy("id").agg(F.min("path").alias("path"), F.count("path").alias("n"))
    return best.select("id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several images for "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("path")).alias("path"))
