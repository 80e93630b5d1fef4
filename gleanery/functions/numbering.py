"""Positions in a global order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import shared_table


def _spelled(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def positions(df: DataFrame, groups: list[str], order: list[Column | str], name: str = "pos", start: int = 1) -> DataFrame:
    """``row_number`` per ``groups`` in ``order``, also where one group holds most rows.

    Rows are range-partitioned by group *and* order, so a large group spreads over many
    tasks.  Each partition numbers its own rows; the counts of (partition, group), at
    most one row per partition and group, give the offsets.  ``order`` must be unique in
    a group for a repeatable result.  An empty input gives an empty result.
    """
    keys = [F.col(g) for g in groups]
    spread = df.repartitionByRange(*keys, *_spelled(order)).sortWithinPartitions(*keys, *_spelled(order))
    kept = shared_table(spread.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    parts = kept.groupBy("__part", *groups).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if groups else None
    if groups:
        parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:  # one row per partition
        parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__first", "__before")
    match = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    drop = ["__part", "__row", "__p", "__first", "__before", *[f"__g{i}" for i in range(len(groups))]]
    return kept.join(parts, match).withColumn(name, F.col("__before") + F.col("__row") - F.col("__first") + start).drop(*drop)
