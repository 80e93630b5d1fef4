"""From questions to answers with sources, in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import providers
from gleanery.operators import search


def retrieve(questions: DataFrame, index: DataFrame, vectors: DataFrame | None = None, k: int = 10, leg_k: int = 40, threshold: float | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25, or fused with dense search where vectors are given, cut at ``threshold``.

    questions: (query_id, query[, vector]); index: (chunk_id, row_idx, body); vectors: (chunk_id, row_idx, vector).
    """
    lexical = search.bm25(questions.select("query_id", "query"), index, leg_k)
    if vectors is None:
        hits = search.min_max(lexical).where(F.col("rank") <= k)
    else:
        near = search.dense(questions.select("query_id", "vector"), vectors, leg_k)
        hits = search.fuse({"dense": near, "bm25": lexical}, k).select("query_id", "chunk_id", "score", "rank")
    return search.above(hits, threshold) if threshold is not None else hits


def answers(questions: DataFrame, hits: DataFrame, texts: DataFrame, budget: int = 12000, generate: providers.Generate | None = None, history: DataFrame | None = None) -> DataFrame:
    """(query_id, query, prompt, answer, sources): one row per question, also where nothing was found.

    The context holds the ranked texts up to the first that exceeds ``budget``; a question has
    at most as many sources as hits.  ``history``: (query_id, turns).
    """
    found = search.context_budget(hits.join(texts.select("chunk_id", "text"), "chunk_id"), F.length(F.coalesce("text", F.lit(""))), budget)
    packed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "text"))).alias("sources"))
    rows = questions.select("query_id", "query").join(packed, "query_id", "left")
    rows = rows.join(history.select("query_id", "turns"), "query_id", "left") if history is not None else rows.withColumn("turns", F.lit(None).cast("string"))
    context = F.array_join(F.transform(F.coalesce("sources", F.array().cast(packed.schema["sources"].dataType)), lambda s: F.format_string("[%d] %s", s["rank"], F.coalesce(s["text"], F.lit("")))), "\n")
    asked = rows.withColumn("prompt", providers.prompt(F.col("query"), context, F.col("turns")))
    return asked.withColumn("answer", providers.answer(F.col("prompt"), generate)).select("query_id", "query", "prompt", "answer", "sources")


def evaluated(rows: DataFrame, judge: providers.Judge | None = None) -> DataFrame:
    """Answered rows with all metrics; rows that the heuristic leaves open go to the judge, others never do."""
    from gleanery.operators import metrics

    measured = metrics.retrieval_metrics(rows)
    if judge is None:
        return metrics.answer_metrics(measured)
    open_ = metrics.heuristic_score(F.col("expected_answer"), F.col("answer")).isNull() & (F.length(F.trim(F.coalesce("expected_answer", F.lit("")))) > 0)
    split = measured.withColumn("__open", open_)
    verdict = providers.judged(F.coalesce("question", F.lit("")), F.col("expected_answer"), F.coalesce("answer", F.lit("")), judge)
    asked = split.where("__open").withColumn("judged", verdict["score"])
    rest = split.where("NOT __open").withColumn("judged", F.lit(None).cast("int"))
    return metrics.answer_metrics(asked.unionByName(rest), F.col("judged")).drop("__open", "judged")
