"""One ranking from several scores of different scales, by weighted median rank.

Only ranks enter, so no scorer counts for more because its scores are larger or more
widely spread.  Ranks come from a range-partitioned global order, so one question may
hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.numbering import positions
from gleanery.storage import shared_table


def scorer_ranks(hits: DataFrame) -> DataFrame:
    """(eval_id, chunk_id, scorer, rank, n): mean rank of each hit among the ``n`` hits of its question and scorer.

    Null and NaN scores and null keys are no hits; of repeated hits the best score counts.
    Equal scores share the mean of their ranks, so a constant list has one rank.
    """
    sound = hits.where("score IS NOT NULL AND NOT isnan(score) AND eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL")
    best = shared_table(sound.groupBy("eval_id", "scorer", "chunk_id").agg(F.max("score").alias("score")))
    values = best.groupBy("eval_id", "scorer", "score").agg(F.count(F.lit(1)).alias("ties"))
    placed = positions(values, ["eval_id", "scorer"], [F.col("score").desc()], "place")
    # hits above each value: per range partition first, then within; `place` is dense over values, so sum ties in slices of 4096 places
    slices = placed.withColumn("slice", F.floor(F.col("place") / 4096))
    sums = slices.groupBy("eval_id", "scorer", "slice").agg(F.sum("ties").alias("s"))
    w = Window.partitionBy("eval_id", "scorer")
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("s").over(w)).drop("s")
    inner = Window.partitionBy("eval_id", "scorer", "slice").orderBy("place")
    ranked = slices.withColumn("within", F.sum("ties").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties"))
    ranked = ranked.join(sums, ["eval_id", "scorer", "slice"]).select("eval_id", "scorer", "score", "n", (F.col("before") + F.col("within") + (F.col("ties") + 1) / 2).alias("rank"))
    return best.join(ranked, ["eval_id", "scorer", "score"]).select("eval_id", "chunk_id", "scorer", "rank", "n")


def median_ranking(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(eval_id, chunk_id, n_scorers, median_rank, mean_rank, rank_no) of every chunk hit.

    A scorer that answered the question but missed the chunk ranks it below all its own
    hits (n + 1).  Order: weighted median rank, weighted mean rank, chunk id.  ``weights``
    gives scorers weights other than 1; a scorer of weight 0 does not count.  A chunk hit
    only by scorers of weight 0 is left out; empty input gives an empty ranking.
    """
    ranks = scorer_ranks(hits)
    if weights:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        ranks = ranks.withColumn("weight", F.coalesce(table[F.col("scorer")], F.lit(1.0))).where("weight > 0")
    else:
        ranks = ranks.withColumn("weight", F.lit(1.0))
    ranks = shared_table(ranks)
    lists = ranks.groupBy("eval_id", "scorer").agg(F.first("n").alias("n"), F.first("weight").alias("weight"))
    lists = lists.groupBy("eval_id").agg(F.collect_list(F.struct("scorer", "n", "weight")).alias("lists"))  # one entry per scorer
    own = ranks.groupBy("eval_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("scorer", "rank"))).alias("own"))
    both = own.join(lists, "eval_id").withColumn("rw", F.expr("array_sort(transform(lists, l -> named_struct('rank', coalesce(own[l.scorer], double(l.n + 1)), 'weight', l.weight)))"))
    half = "aggregate(rw, 0D, (a, x) -> a + x.weight) / 2"
    running = f"aggregate(rw, named_struct('w', 0D, 'lo', double(null), 'hi', double(null)), (a, x) -> named_struct('w', a.w + x.weight, 'lo', coalesce(a.lo, if(a.w + x.weight >= {half}, x.rank, null)), 'hi', coalesce(a.hi, if(a.w + x.weight > {half}, x.rank, null))))"
    scored = both.withColumn("m", F.expr(running)).select(
        "eval_id",
        "chunk_id",
        F.size("own").cast("bigint").alias("n_scorers"),
        F.round(F.expr("(m.lo + m.hi) / 2"), 6).alias("median_rank"),
        F.round(F.expr("aggregate(rw, 0D, (a, x) -> a + x.rank * x.weight) / aggregate(rw, 0D, (a, x) -> a + x.weight)"), 6).alias("mean_rank"),
    )
    return positions(scored, ["eval_id"], ["median_rank", "mean_rank", "chunk_id"], "rank_no")
