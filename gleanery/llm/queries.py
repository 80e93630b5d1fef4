"""The registered queries of this subpackage: (spark, directory of parquet tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import canonical, copies, encoding, mixing, packing, pairs, pieces, ranking, repetition, scans
from gleanery.session import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return canonical.records(table(spark, d, "documents"), table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alikes(_records(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_groups(_records(spark, d))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    placed = packing.packed(table(spark, d, "table_rows"))
    return placed.where("n_chars > 1200").groupBy("row_id").agg(F.first("n_chars")).select("row_id")


def p1_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "table_rows"))


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "table_rows")
    return packing.chunk_texts(rows, packing.packed(rows))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the chunks of each table hold, and whether all of them fit."""
    key = ["file_name", "table_id"]
    placed = packing.packed(table(spark, d, "table_rows")).where("size > 0")
    bins = placed.groupBy(*key, "chunk_id").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("pieces"))
    fits = bins.groupBy(*key).agg(F.sum("chars").alias("n_chars"), F.bool_and(F.col("chars") + F.col("pieces") - 1 <= 1200).alias("fits"))
    rows = placed.groupBy(*[F.col(k).alias(f"p_{k}") for k in key]).agg(F.countDistinct("row_id").alias("n_rows"))
    return fits.join(rows, F.col("file_name").eqNullSafe(F.col("p_file_name")) & F.col("table_id").eqNullSafe(F.col("p_table_id"))).select(*key, "n_rows", "n_chars", "fits")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "chunks")).toDF("chunk_id_a", "chunk_id_b")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "eval_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_records(spark, d)).where("scanned").select("rec_kind", "rec_id")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_records(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.pieces(_records(spark, d))
    return cut.where("n_chars > 1200 AND piece_no = 1").select("rec_kind", "rec_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_records(spark, d))


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each text put together again, and whether all of them fit."""
    cut = pieces.pieces(_records(spark, d))
    new = F.expr("substring(text, `new` - `start` + 1)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))), lambda x: x["t"]), "")
    fits = F.bool_and((F.length("text") <= 1200) & (F.col("new") - F.col("start") <= 200))
    return cut.groupBy("rec_kind", "rec_id").agg(F.max("n_chars").cast("bigint").alias("n_chars"), F.md5(whole).alias("whole"), fits.alias("fits"))


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The ranking in which the dense scorer counts three times and the reranker not at all."""
    return ranking.median_ranking(table(spark, d, "ranked_chunks"), {"dense": 3.0, "rerank": 0.0})


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.median_ranking(table(spark, d, "ranked_chunks"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_scarce(spark: SparkSession, d: str) -> DataFrame:
    """Shares where the mix is as large as all documents of the targets: scarce sources fall short, their siblings take the rest."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total=mixing.whole_supply)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measured(table(spark, d, "documents"))


def p10_bands(spark: SparkSession, d: str) -> DataFrame:
    return repetition.script_bands(table(spark, d, "documents"))


def queries() -> dict:
    named = [p1_found, p1_packed, p1_chunks, p1_cover, p2_found, p2_records, p3_found, p3_groups, p3_canonical, p4_found, p5_found, p5_repaired, p6_found, p6_pieces, p6_cover, p7_ranking, p7_weighted, p8_ids, p9_mix, p9_shares, p9_scarce, p10_found, p10_shares, p10_bands]
    return {f.__name__: f for f in named}
