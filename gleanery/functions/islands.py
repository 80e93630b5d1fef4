"""Looking back along ordered groups of any size: earlier values, values carried forward, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import shared_table


def scan(df: DataFrame, groups: list[str], order: list[str], lag: list[str] | None = None, fill: list[str] | None = None, total: list[str] | None = None) -> DataFrame:
    """Adds ``prev_<c>`` for lag, ``last_<c>`` for fill and ``upto_<c>`` for total, along ``order`` within ``groups``.

    prev: the value of the row before, null for a group's first row; last: the last value
    known so far, this row's included; upto: the sum so far.  Rows are range-partitioned by
    group and order, so windows span one partition's share of a group; what crosses a border
    comes from one row per partition and group.  ``order`` must be unique in a group.
    """
    lag, fill, total = lag or [], fill or [], total or []
    keys = [F.col(c) for c in [*groups, *order]]
    placed = shared_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    at: Column = F.struct(*order)
    here = Window.partitionBy(*groups, "__part").orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"__l_{c}") for c in lag]
    ends += [F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), at)).alias(f"__f_{c}") for c in fill]
    ends += [F.sum(c).alias(f"__t_{c}") for c in total]
    parts = placed.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"), *ends)
    order_of_parts = Window.partitionBy(*groups).orderBy("__part")
    before = order_of_parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.lag(f"__l_{c}").over(order_of_parts).alias(f"__l_{c}") for c in lag]
    carried += [F.last(f"__f_{c}", ignorenulls=True).over(before).alias(f"__f_{c}") for c in fill]
    carried += [F.sum(f"__t_{c}").over(before).alias(f"__t_{c}") for c in total]
    parts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), *carried)
    own = placed.withColumns({f"prev_{c}": F.lag(F.struct(F.col(c).alias("v"))).over(here) for c in lag} | {f"last_{c}": F.last(c, ignorenulls=True).over(so_far) for c in fill} | {f"upto_{c}": F.sum(c).over(so_far) for c in total})
    match = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    met = own.join(parts, match)
    met = met.withColumns({f"prev_{c}": F.coalesce(F.col(f"prev_{c}"), F.col(f"__l_{c}"))["v"] for c in lag} | {f"last_{c}": F.coalesce(F.col(f"last_{c}"), F.col(f"__f_{c}")["v"]) for c in fill} | {f"upto_{c}": F.coalesce(F.col(f"upto_{c}"), F.lit(0)) + F.coalesce(F.col(f"__t_{c}"), F.lit(0)) for c in total})
    return met.drop("__part", "__p", *[f"__g{i}" for i in range(len(groups))], *[f"__l_{c}" for c in lag], *[f"__f_{c}" for c in fill], *[f"__t_{c}" for c in total])
