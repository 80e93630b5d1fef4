"""Lexical, dense and fused search over whole batches of queries.

Corpus tables: ``index_text(chunk_id, row_idx, body)``; queries: ``(query_id, query)``.
Postings and statistics are ordinary DataFrames that may be written and read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import blocks
from gleanery.storage import shared_table

K1, B = 1.5, 0.75
RRF_K = 60
FIELDS = ["file_name", "source_file", "section_path_text", "section_type", "heading", "content_type", "chunk_type", "table_id", "table_type", "row_range"]


def search_text(doc_id: Column, metadata: Column, text: Column) -> Column:
    """Document id, metadata fields and text, blank parts left out, one per line."""
    parts = F.array(doc_id.cast("string"), *[metadata[f] for f in FIELDS], text)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.length(T.strip(x)) > 0)), "\n")


def postings(index: DataFrame, key: str = "chunk_id", body: str = "body") -> DataFrame:
    """(term, key, tf, dl): term counts and lengths; only terms of one row meet in a task before the count."""
    tokenised = index.select(key, T.tokens(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    terms = tokenised.select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(index: DataFrame, body: str = "body") -> DataFrame:
    """One row: n_chunks, avg_len over all rows, empty ones included."""
    sizes = index.select(F.size(T.tokens(F.coalesce(F.col(body), F.lit("")))).alias("dl"))
    return sizes.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_len"))


def document_frequency(posts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.coalesce("query", F.lit(""))))).alias("term"))


def bm25(queries: DataFrame, index: DataFrame, k: int = 10, same: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 top ``k``; ties by row_idx (a number).

    ``allowed`` (query_id, chunk_id) restricts the hits to its pairs, which alone are scored
    then.  ``same`` names a column of both sides that must be equal for a hit; the statistics stay
    those of the whole corpus.  Queries without a matching term have no rows.  Terms are
    compared by 64-bit hashes.  The texts are read and cut into terms once; the statistics
    are one row and one row per asked term; scores come from pairs of blocks.
    """
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    keep = [F.col(same).alias("key")] if same else []
    tokenised = shared_table(index.select("chunk_id", F.col("row_idx").cast("bigint").alias("row_idx"), *keep, hashed(T.tokens(F.coalesce("body", F.lit("")))).alias("terms")))
    stats = tokenised.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("terms")).alias("average"))
    asked = queries.select("query_id", *keep, F.explode(F.array_distinct(hashed(T.tokens(F.coalesce("query", F.lit("")))))).alias("term"))
    asked = shared_table(asked)
    df = tokenised.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats.select("n_chunks"))).groupBy("query_id", *(["key"] if same else [])).agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("x"))  # the terms of one query; one row of statistics
    q = weighted.select("query_id", *(["key"] if same else []), F.col("x.term").alias("terms"), F.col("x.idf").alias("idf"))
    rows = tokenised.crossJoin(F.broadcast(stats.select("average")))  # one row of statistics
    if allowed is None:
        return top_k(blocks.matched(q, rows, blocks.bm25_scorer(K1, B), k), k)
    pairs = allowed.select("query_id", "chunk_id").distinct().join(rows.drop("key"), "chunk_id").join(q.select("query_id", F.col("terms").alias("asked"), "idf"), "query_id")
    length, mean = F.size("terms"), F.greatest("average", F.lit(1e-9))
    tf = lambda t: F.size(F.filter("terms", lambda x: x == t))
    part = F.zip_with("asked", "idf", lambda t, w: w * tf(t) * (K1 + 1) / (tf(t) + K1 * (1 - B + B * length / mean)))
    return top_k(pairs.withColumn("score", F.aggregate(part, F.lit(0.0), lambda a, x: a + x)).where("score > 0"), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; ranks from 1, ties by row_idx.  Limits are taken before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "row_idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, computed in double; null where one is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, same: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top ``k`` of each query vector; ties by row_idx (a number).

    ``queries``: (query_id, vector); ``vectors``: (chunk_id, row_idx, vector).  A stated
    query set against all rows, in blocks: each pair of blocks is one product of matrices
    and gives its ``k`` best per query.  ``same`` names a column of both sides that must be
    equal.  Null and zero vectors, and those of another size, have no hits.
    """
    keep = [F.col(same).alias("key")] if same else []
    double = F.col("vector").cast("array<double>").alias("vector")
    hits = blocks.matched(queries.select("query_id", *keep, double), vectors.select("chunk_id", F.col("row_idx").cast("bigint").alias("row_idx"), *keep, double), blocks.vector_scorer, k)
    return top_k(hits, k)


def min_max(hits: DataFrame, score: str = "score", name: str = "score") -> DataFrame:
    """Scores of each query scaled to [0, 1]; equal scores become 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    even = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return hits.withColumn(name, F.when(even, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def fuse(legs: dict[str, DataFrame], k: int | None = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, chunk_id, rrf, <leg>_rank..., score, rank).

    ``score`` is the fused value, min-max scaled over the whole fused list before the cut.
    Ties keep the order of the legs: by rank in the first leg, then in the next.
    """
    tagged = [leg.select("query_id", "chunk_id", *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"{n}_rank") for n in legs]) for name, leg in legs.items()]
    ranks = [f"{n}_rank" for n in legs]
    both = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "chunk_id").agg(*[F.min(r).alias(r) for r in ranks])
    rrf = sum(F.coalesce(1 / (rrf_k + F.col(r)), F.lit(0.0)) for r in ranks)
    fused = min_max(both.withColumn("rrf", rrf), "rrf")
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), *[F.col(r).asc_nulls_last() for r in ranks], "chunk_id")
    fused = fused.withColumn("rank", F.row_number().over(w))
    return fused if k is None else fused.where(F.col("rank") <= k)


def rerank(hits: DataFrame, scorer: Column, candidates: int = 20, k: int = 10) -> DataFrame:
    """Score the first ``candidates`` of each query anew, scale the scores, keep the best ``k``."""
    cut = hits.where(F.col("rank") <= max(candidates, k)).withColumn("score", scorer)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return min_max(cut).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: the reranker used without a model."""
    q = F.array_distinct(T.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, T.tokens(text))).cast("double"), F.size(q)), F.lit(0.0))


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits of at least ``threshold``."""
    return hits.where(F.col("score") >= threshold)


def context_budget(hits: DataFrame, length: Column, budget: int = 12000) -> DataFrame:
    """The ranked rows of each query up to the first whose running length exceeds ``budget``."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def last_turns(chat: DataFrame, conversation: str, turn: str, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    return chat.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))


def _containing(asked: DataFrame, lookup: DataFrame, n: int) -> DataFrame:
    """(qkey, canonical) where one key contains the other: candidates share the first ``n`` characters of the shorter one, then are verified.

    Keys under ``n`` characters are matched through their own whole text among all parts of
    that length.
    """
    parts = lambda df, c, keep: df.select(*keep, F.explode(F.concat(F.when(F.length(c) >= n, _grams(F.col(c), n)).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(n - 1), F.length(c))), lambda m: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - m + 1), lambda i: F.substring(c, i, m))))))).alias("g"))
    head = lambda c: F.left(c, F.lit(n))
    inside = parts(lookup, "key", ["key", "canonical"]).join(asked.select("qkey", head(F.col("qkey")).alias("g")), "g").where("contains(key, qkey)")
    around = parts(asked, "qkey", ["qkey"]).join(lookup.select("key", "canonical", head(F.col("key")).alias("g")), "g").where("contains(qkey, key)")
    return inside.select("qkey", "canonical").unionByName(around.select("qkey", "canonical"))


def resolve_scope(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, query_doc, scope): the document a query names.

    ``names``: (doc_id, file_name, source_file, pos).  An exact key wins (of equal keys the
    last row's), else the only name that contains or is contained in the key, else the raw
    string; a blank one gives null.
    """
    canonical = F.coalesce(F.nullif(T.strip(F.coalesce("file_name", F.lit(""))), F.lit("")), F.nullif(T.strip(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit("")))
    spelled = names.withColumn("canonical", canonical).where("canonical IS NOT NULL")
    keys = spelled.select("canonical", "pos", F.explode(F.array(F.col("doc_id").cast("string"), "file_name", "source_file")).alias("name")).where("name IS NOT NULL AND name <> ''")
    lookup = keys.select(T.doc_key(F.col("name")).alias("key"), "canonical", "pos").groupBy("key").agg(F.max_by("canonical", "pos").alias("canonical"))
    asked = queries.select("query_id", "query_doc", T.strip(F.coalesce("query_doc", F.lit(""))).alias("raw"))
    asked = asked.withColumn("qkey", T.doc_key(F.col("raw")))
    distinct = asked.where("raw <> ''").select("qkey").distinct()
    exact = distinct.join(lookup, distinct.qkey == lookup.key).select("qkey", F.col("canonical").alias("exact"))
    open_ = distinct.join(exact, "qkey", "left_anti")
    near = _containing(open_, lookup, 5).groupBy("qkey").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("near"))
    out = asked.join(exact, "qkey", "left").join(near.where("n = 1").drop("n"), "qkey", "left")
    return out.select("query_id", "query_doc", F.when(F.col("raw") == "", None).otherwise(F.coalesce("exact", "near", "raw")).alias("scope"))
