"""Sampling of chunks for evaluation, by quotas and by strides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.numbering import positions

# How many chunks of each section type a document gives.
QUOTAS = {"overview": 1, "requirements": 4, "evaluation": 2, "bid_contract": 2, "security": 1, "appendix_form": 1}


def parse_quotas(raw: str | None) -> dict[str, int]:
    """``k=v,k=v`` over the default quotas."""
    out = dict(QUOTAS)
    for item in (raw or "").split(","):
        if item.strip():
            k, eq, v = item.partition("=")
            if not eq or not k.strip():
                raise ValueError(f"not a quota: {item!r}")
            out[k.strip()] = int(v)
    return out


def score(chunk_type: Column, length: Column, path: Column, part: Column) -> Column:
    """Type, length band, path and part of a chunk as points."""
    kind = F.when(chunk_type == "section_text", 30).when(chunk_type == "cover_text", -20).otherwise(0)
    band = F.when(length.between(250, 1600), 25).when(length.between(120, 249), 12).when(length.between(1601, 2800), 8).when(length < 120, -35).otherwise(-10)
    part = F.coalesce(part, F.lit(9999))
    return kind + band + F.when(F.length(F.coalesce(path, F.lit(""))) > 0, 8).otherwise(0) + F.when(part == 1, 8).otherwise(-F.least(part, F.lit(15)))


def candidates(chunks: DataFrame, least: int = 80) -> DataFrame:
    """(chunk_id, doc, section_type, section_path, n, part, score, row_idx) of chunks of at least ``least`` clean characters."""
    m = F.col("metadata")
    body = T.clean_block(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.nullif(m["file_name"], F.lit("")), F.nullif(m["source_file"], F.lit("")), F.col("doc_id").cast("string"), F.lit("unknown_document"))
    made = chunks.select(
        "chunk_id", "row_idx", doc.alias("doc"), F.coalesce(F.nullif(m["section_type"], F.lit("")), F.lit("body")).alias("section_type"), F.coalesce(m["section_path_text"], F.lit("")).alias("section_path"),
        F.length(body).alias("n"), F.try_to_number(m["part_index"], F.lit("999999")).cast("int").alias("part"), "chunk_type",
    )
    return made.where(F.col("n") >= least).withColumn("score", score(F.coalesce("chunk_type", F.lit("")), F.col("n"), F.col("section_path"), F.col("part"))).drop("chunk_type")


def by_quota(cands: DataFrame, quotas: dict[str, int] | None = None, sparse: int = 0) -> DataFrame:
    """The best candidates of each document and section, distinct paths first, within the quotas.

    Appendix forms come only to documents with fewer than ``sparse`` other picks, or to all if 0.
    """
    quotas = quotas or QUOTAS
    table = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    own = F.struct((-F.col("score")).alias("s"), F.coalesce("part", F.lit(9999)).alias("p"), F.col("row_idx").alias("i"))
    wanted = cands.where(F.col("section_type").isin(list(quotas)))
    # of one path at most a quota's number of rows can be picked, and of a section the best rows of as many paths:
    # each path keeps its first rows within hash buckets, so a hot document is cut down before its windows
    most = max(quotas.values())
    bucket = F.pmod(F.xxhash64("row_idx"), F.lit(64))
    local = Window.partitionBy("doc", "section_type", "section_path", "__b").orderBy(own)
    cut = wanted.withColumn("__b", bucket).withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= most).drop("__b", "__r")
    path = Window.partitionBy("doc", "section_type", "section_path").orderBy(own)
    ranked = cut.withColumn("__n", F.row_number().over(path)).where(F.col("__n") <= most).withColumn("again", (F.col("__n") > 1).cast("int")).drop("__n")
    order = [F.col("again"), F.col("score").desc(), F.col("section_path"), F.coalesce("part", F.lit(9999)), F.col("row_idx")]
    w = Window.partitionBy("doc", "section_type").orderBy(*order)
    picked = ranked.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= table[F.col("section_type")])
    if sparse:
        core = F.sum((F.col("section_type") != "appendix_form").cast("int")).over(Window.partitionBy("doc"))
        picked = picked.withColumn("core", core).where((F.col("section_type") != "appendix_form") | (F.col("core") < sparse)).drop("core")
    return picked.drop("again")


def by_document(cands: DataFrame, quotas: dict[str, int] | None = None, least: int = 0) -> DataFrame:
    """:func:`by_quota`, appendix forms only where a document has fewer than ``least`` other picks, and body text up to ``least`` where it still has fewer.

    Adds rank_in_doc and rank_in_section, in the order of the sections and then of the picks.
    """
    quotas = quotas or QUOTAS
    picked = by_quota(cands, quotas, least)
    if least:
        have = picked.groupBy("doc").agg(F.count(F.lit(1)).alias("k"))
        body = by_quota(cands.where("section_type = 'body'"), {"body": least}).join(have, "doc", "left").where(F.col("pick") <= least - F.coalesce("k", F.lit(0))).drop("k")
        picked = picked.unionByName(body)
    names = [*quotas, "body"]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("section_type"))
    doc = Window.partitionBy("doc").orderBy(place, "pick", "row_idx")  # at most the sum of the quotas
    return picked.withColumns({"rank_in_doc": F.row_number().over(doc), "rank_in_section": F.col("pick")})


def sampling_report(cands: DataFrame, picked: DataFrame) -> DataFrame:
    """(measure, value): rows, candidates, documents, rows per document, and rows of each section."""
    per = picked.groupBy("doc").agg(F.count(F.lit(1)).alias("k"))
    sums = per.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("rows"), F.count(F.lit(1)).cast("double").alias("documents"), F.min("k").cast("double").alias("min_per_doc"), F.max("k").cast("double").alias("max_per_doc"), F.round(F.avg("k"), 2).alias("avg_per_doc"))
    wide = sums.select(F.expr("stack(5, 'rows', rows, 'documents', documents, 'min_per_doc', min_per_doc, 'max_per_doc', max_per_doc, 'avg_per_doc', avg_per_doc) AS (measure, value)"))
    n = cands.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("candidates").alias("measure"), "value")
    sections = picked.groupBy(F.concat(F.lit("section:"), "section_type").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return wide.unionByName(n).unionByName(sections)


def sampling_summary(picked: DataFrame) -> DataFrame:
    """One row: rows, documents, and rows per document (min, max, average)."""
    per = picked.groupBy("doc").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_docs"), F.min("k").alias("min_per_doc"), F.max("k").alias("max_per_doc"), F.round(F.avg("k"), 2).alias("avg_per_doc"))


def stride(df: DataFrame, order: list[str], m: int) -> DataFrame:
    """``m`` rows at even distances over the given order: positions round-half-even(i * (n - 1) / (m - 1))."""
    placed = positions(df, [], order, "pos", 0)
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    step = F.when(F.lit(m) > 1, (F.col("n") - 1) / F.lit(max(m - 1, 1))).otherwise(F.lit(0.0))
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), "n").select(F.when(F.col("n") <= m, F.col("i")).otherwise(F.bround(F.col("i") * step)).cast("bigint").alias("pos")).distinct()
    return placed.join(F.broadcast(wanted), "pos", "left_semi")  # m rows
