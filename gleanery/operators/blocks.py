"""A stated set of queries against all rows, in blocks: both sides are packed, and each pair of blocks is one row.

A pair of blocks gives at most ``k`` hits per query, so what is shuffled afterwards does not
grow with the pairs that are compared; a frequent term or a large document is spread over
the blocks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a block.
QUERIES, ROWS = 512, 4096


def _whole(column: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def packed(df: DataFrame, size: int) -> DataFrame:
    """Each column as one array per block of up to ``size`` rows; rows of a block come from one partition."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays([_whole(pa.concat_arrays([part.column(i)])) for i in range(len(names))], names)

    kinds = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema.fields)
    return df.mapInArrow(run, kinds)


def best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best scores, ties (to nine digits) by ``order``; NaN is no score."""
    at = np.flatnonzero(~np.isnan(score))
    rounded = np.round(score[at], 9)
    if len(at) > k:
        keep = rounded >= np.partition(rounded, -k)[-k]
        at, rounded = at[keep], rounded[keep]
    return at[np.lexsort((order[at], -rounded))[:k]]


def matched(queries: DataFrame, rows: DataFrame, scorer: Callable, k: int, query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """(query_id, chunk_id, row_idx, score): at most ``k`` hits per query and pair of blocks.

    ``scorer(q, r)`` gets the columns of two blocks as Arrow arrays by name and yields
    (query index, scores of the rows), NaN where a row is no hit.
    """
    q = packed(queries, query_block)
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    r = packed(rows, row_block)
    q_kind, c_kind = queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(j)[i].values for j, n in enumerate(batch.schema.names)}
                left, right = {n[2:]: v for n, v in one.items() if n.startswith("q_")}, {n: v for n, v in one.items() if not n.startswith("q_")}
                order = right["row_idx"].to_numpy(zero_copy_only=False)
                at_q, at_r, scores = [], [], []
                for query, score in scorer(left, right):
                    hits = best(score, order, k)
                    at_q.append(np.full(len(hits), query))
                    at_r.append(hits)
                    scores.append(score[hits])
                if at_q:
                    a, b = pa.array(np.concatenate(at_q).astype(np.int64)), pa.array(np.concatenate(at_r).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([left["query_id"].take(a), right["chunk_id"].take(b), right["row_idx"].take(b), pa.array(np.concatenate(scores))], ["query_id", "chunk_id", "row_idx", "score"])

    pairs = r.crossJoin(q)  # of blocks, not of rows
    return pairs.mapInArrow(run, f"query_id {q_kind}, chunk_id {c_kind}, row_idx bigint, score double")


def vector_scorer(left: dict, right: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of two blocks by one product of matrices; rows of another ``key`` are no hits."""

    def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(column.offsets.to_numpy())
        sizes[~np.asarray(column.is_valid())] = 0
        size = int(sizes.max(initial=0))
        good = np.flatnonzero((sizes == size) & (size > 0))
        flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = flat.reshape(len(good), size) if size else np.zeros((0, 0))
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            return good, m / norm

    (a_at, a), (b_at, b) = units(left["vector"]), units(right["vector"])
    if not len(a) or not len(b) or a.shape[1] != b.shape[1]:
        return
    product = a @ b.T
    keys = (np.array(left["key"].to_pylist(), object), np.array(right["key"].to_pylist(), object)) if "key" in left else None
    for n, query in enumerate(a_at):
        if keys is not None and keys[0][query] is None:
            continue
        score = np.full(len(right["chunk_id"]), np.nan)
        score[b_at] = product[n]
        if keys is not None:
            score[keys[1] != keys[0][query]] = np.nan
        if not np.isnan(score).all():
            yield int(query), score


def bm25_scorer(k1: float, b: float) -> Callable:
    """Scores of two blocks of hashed terms: ``terms`` and ``idf`` per query, ``terms`` and ``average`` length per row."""

    def scorer(left: dict, right: dict) -> Iterator[tuple[int, np.ndarray]]:
        n = len(right["chunk_id"])
        offsets = right["terms"].offsets.to_numpy()
        length = np.diff(offsets)
        tokens = right["terms"].flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), length)
        asked = left["terms"].flatten().to_numpy(zero_copy_only=False)
        starts = left["terms"].offsets.to_numpy() - left["terms"].offsets.to_numpy()[0]
        idf = left["idf"].flatten().to_numpy(zero_copy_only=False)
        known = np.unique(asked)
        if not len(known) or not len(tokens):
            return
        place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        own = known[place] == tokens
        pair, tf = np.unique(place[own] * n + owner[own], return_counts=True)
        term, row = pair // n, pair % n
        average = max(float(right["average"][0].as_py()), 1e-9)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
        bounds = np.searchsorted(term, np.arange(len(known) + 1))
        at = np.searchsorted(known, asked)
        keys = (np.array(left["key"].to_pylist(), object), np.array(right["key"].to_pylist(), object)) if "key" in left else None
        for query in range(len(left["query_id"])):
            if keys is not None and keys[0][query] is None:
                continue
            score = np.zeros(n)
            for j in range(starts[query], starts[query + 1]):
                seg = slice(bounds[at[j]], bounds[at[j] + 1])
                score[row[seg]] += idf[j] * part[seg]
            score[score <= 0] = np.nan
            if keys is not None:
                score[keys[1] != keys[0][query]] = np.nan
            if not np.isnan(score).all():
                yield query, score

    return scorer
