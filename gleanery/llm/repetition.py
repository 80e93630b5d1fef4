"""Repetition inside single documents, seen through a public vocabulary.

Words are encoded by a public tokenizer; a document's fertility figures are characters
per token, the share of byte-fallback tokens and the entropy of its token groups.  Where
the entropy of adjacent token groups reaches its maximum nothing occurs twice, so a low
entropy band per script rejects documents without repetition; the rest are measured
exactly, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.bpe import LETTER, NUMBER, byte_bpe, classes, code_points
from gleanery.llm.canonical import sliced

#: Words of a repeated stretch, and how often a shorter group stands in a row to count.
STRETCH, IN_A_ROW = 6, 3
#: Bits by which the entropy of adjacent words must fall short of its maximum, by script.  A document with
#: a repeated share of 0.3 in words of usual length falls short by more than 0.1 bits.
BANDS = {"hangul": 0.02, "latin": 0.02, "other": 0.01}
#: Documents with a word of more letters than this are measured whatever their entropy.
LONG_WORD = 40
SHARE = 0.3
AT_ONCE = 1_500_000


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of several integer columns."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h


def _words(texts: list[str]):
    """Words of all texts, without numbering: their strings, letters, texts and the scripts of the texts."""
    joined, points, ends = code_points([t.lower() for t in texts])
    c = classes()[points]
    c[ends] = 0
    counted = (c == LETTER) | (c == NUMBER)
    inside = counted.copy()
    rare = points > 0x2FF
    if rare.any():  # marks belong to the words they stand in
        inside |= rare & (_marks()[points])
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    counts = np.concatenate(([0], np.cumsum(counted)))
    letters = counts[stops] - counts[starts]
    digits = np.concatenate(([0], np.cumsum(c == NUMBER)))
    # numbering: up to three digits, or one letter, that a dot or bracket follows and only a bracket or white space precedes
    sizes = stops - starts
    after, then = points[stops], points[np.minimum(stops + 1, len(points) - 1)]
    before = np.where(starts > 0, points[np.maximum(starts - 1, 0)], 0x0A)
    numeric = (digits[stops] - digits[starts]) == sizes
    dotted = np.isin(after, [0x2E, 0x29, 0x3A, 0x5D]) & ((then == 0x20) | (then == 0x0A) | (then == 0x09) | (then == 0x2E))
    lead = np.isin(before, [0x0A, 0x20, 0x09, 0x28, 0x5B])
    opens = np.isin(before, [0x0A, 0x28, 0x5B])
    circled = (sizes == 1) & (points[starts] >= 0x2460) & (points[starts] <= 0x24FF)
    keep = (letters > 0) & ~(numeric & (sizes <= 3) & dotted & lead) & ~((sizes == 1) & dotted & opens) & ~circled
    starts, stops, letters = starts[keep], stops[keep], letters[keep]
    of = np.searchsorted(ends, starts)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate(([0], ends + 1))])
    hangul = sums((points >= 0xAC00) & (points <= 0xD7A3))
    latin = sums((c == LETTER) & (points < 0x250))
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())], letters, of, hangul, latin


_MARKS: list[np.ndarray] = []


def _marks() -> np.ndarray:
    if not _MARKS:
        import unicodedata

        _MARKS.append(np.fromiter((unicodedata.category(chr(x))[0] == "M" for x in range(0x110000)), bool, 0x110000))
    return _MARKS[0]


def _again(key: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Which rows have an earlier row with the same ``parts``; ``key`` is a hash of them."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        for p in parts:
            same &= p[order][1:] == p[order][:-1]
        out[order[1:][same]] = True
    return out


def repeated(words: np.ndarray, of: np.ndarray, stretch: int = STRETCH, in_a_row: int = IN_A_ROW) -> np.ndarray:
    """Which words lie in a stretch that stood earlier in their text, or in a group repeated in a row."""
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    m = n - stretch + 1
    if m > 0:
        cols = [words[i : i + m] for i in range(stretch)]
        whole = np.flatnonzero(of[:m] == of[stretch - 1 :])
        cols = [c[whole] for c in cols]
        at = whole[_again(_mix(of[whole], *cols), [of[whole], *cols])]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + stretch, -1)
    out = np.cumsum(hit[:n]) > 0
    for period in range(1, stretch):
        if n <= period:
            break
        equal = (words[period:] == words[:-period]) & (of[period:] == of[:-period])
        edges = np.diff(np.concatenate(([False], equal, [False])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if b - a >= period * (in_a_row - 1):
                out[a + period : b + period] = True
    return out


def _entropies(of: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the entropy of its keys in bits, and the number of keys."""
    total = np.bincount(of, minlength=n).astype(float)
    if not len(of):
        return np.zeros(n), total
    pair = _mix(of, key)
    order = np.argsort(pair, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1])))
    count = np.diff(np.append(cut, len(of))).astype(float)
    lost = np.bincount(of[order[cut]], count * np.log2(count), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.log2(total) - lost / total, 0.0), total


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """For each document: script, n_tokens, chars_per_token, fallback_share, token_entropy, entropy_gap, screened, repeated_share.

    ``token_entropy`` is the entropy of the token groups of words, in bits per token;
    ``entropy_gap`` what the entropy of adjacent groups lacks to its maximum; ``screened``
    says that the gap lies in the script's rejection band, so that nothing long can be
    repeated and the exact share is not computed (it is then 0).  Case, punctuation, white
    space and numbering do not count.  Null, empty and wordless texts have share 0.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, script string, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, entropy_gap double, screened boolean, repeated_share double"
    names = [key, "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "entropy_gap", "screened", "repeated_share"]

    def figures(texts: list[str], coder) -> list[np.ndarray]:
        n = len(texts)
        strings, letters, of, hangul, latin = _words(texts)
        words = coder.numbered(strings)
        tokens = coder.lengths[words]
        n_tokens = np.bincount(of, tokens, n)
        chars = np.bincount(of, letters, n)
        fallback = np.bincount(of, coder.parts[words], n)
        single, n_words = _entropies(of, words, n)
        inner = np.flatnonzero(of[1:] == of[:-1])
        double, n_pairs = _entropies(of[inner], _mix(words[inner], words[inner + 1]), n)
        gap = np.log2(np.maximum(n_pairs, 1)) - double
        script = np.where(hangul * 2 >= np.maximum(latin, 1), "hangul", np.where(latin > 0, "latin", "other"))
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, of, letters)
        band = np.select([script == "hangul", script == "latin"], [BANDS["hangul"], BANDS["latin"]], BANDS["other"])
        screened = (gap < band) & (longest <= LONG_WORD)
        share = np.zeros(n)
        rest = np.flatnonzero(~screened[of])
        if rest.size:
            again = repeated(words[rest], of[rest])
            share = np.bincount(of[rest], letters[rest] * again, n) / np.maximum(chars, 1)
        per = np.maximum(n_tokens, 1)
        return [pa.array(script.tolist()), pa.array(n_tokens.astype(np.int64)), pa.array(chars / per), pa.array(fallback / per), pa.array(single * n_words / per), pa.array(gap), pa.array(screened), pa.array(share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = byte_bpe(tokenizer, folder)
        for batch in batches:
            for piece in sliced(batch, text, AT_ONCE):
                yield pa.RecordBatch.from_arrays([piece.column(0), *figures([t or "" for t in piece.column(1).to_pylist()], coder)], names)

    return df.select(key, text).mapInArrow(run, schema)


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The keys of the documents of which at least ``share`` of the letters and digits are repeated."""
    return measured(df, key, text).where(F.col("repeated_share") >= share).select(key)


def script_bands(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per script the 1st, 50th and 99th percentile of each fertility figure over all documents: the bands outside of which a text is unusual."""
    m = measured(df, key, text)
    figures = ["chars_per_token", "fallback_share", "token_entropy", "entropy_gap", "repeated_share"]
    aggregates = [F.percentile_approx(c, [0.01, 0.5, 0.99], 10000).alias(c) for c in figures]
    return m.groupBy("script").agg(F.count(F.lit(1)).alias("n_documents"), *aggregates)
