"""Content-defined pieces of long texts.

A rolling hash over the last 16 characters marks landmarks; the first landmark between
the smallest and the largest size of a piece is moved to the nearest natural boundary of
the strongest kind near it (blank line, line, sentence, word).  Landmarks depend on the
text around them only, so after an edit the cuts soon fall where they fell before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.canonical import sliced

SIZE, OVERLAP, LEAST, NEAR = 1200, 200, 450, 150
#: One landmark in so many characters on average.
SPACING = 128


def landmarks(points: np.ndarray) -> np.ndarray:
    """Positions whose window of 16 code points hashes to 0 modulo SPACING."""
    with np.errstate(over="ignore"):
        h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        return np.flatnonzero((h >> np.uint64(33)) % np.uint64(SPACING) == 0) + 1


def boundaries(points: np.ndarray) -> list[np.ndarray]:
    """Positions before which a text may be cut: after blank lines, lines, sentences, white space."""
    from gleanery.llm.bpe import NUMBER, SPACE, classes

    c = classes()[points]
    space = c == SPACE
    line = points == 0x0A
    ends = np.isin(points, [0x2E, 0x21, 0x3F, 0x3002, 0xFF01, 0xFF1F, 0x2026])
    last = np.zeros(len(points), bool)
    last[:-1] = space[:-1] & ~space[1:]  # the end of a run of white space
    before = np.concatenate(([False], line[:-1]))
    closes = np.concatenate(([False], ends[:-1]))
    digit = c == NUMBER
    dated = np.zeros(len(points), bool)  # "2025. 5. 8." is no end of a sentence
    dated[2:-1] = digit[:-3] & (points[1:-2] == 0x2E) & digit[3:]
    glued = np.zeros(len(points), bool)
    wide = np.isin(points, [0x3002, 0xFF01, 0xFF1F])
    glued[:-1] = wide[:-1] & ~wide[1:]
    return [np.flatnonzero(x) + 1 for x in (line & before, line, (last & closes & ~dated) | glued, last)]


def _nearest(places: list[int], target: int, lo: int, hi: int) -> int | None:
    """The place in [lo, hi] nearest to ``target``, the earlier one of two."""
    i = bisect_left(places, target)
    best = None
    for j in (i - 1, i):
        if 0 <= j < len(places) and lo <= places[j] <= hi and (best is None or target - best > abs(places[j] - target)):
            best = places[j]
    return best


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, new, end) of each piece: [start, new) repeats the piece before, [new, end) is new.

    Pieces have at most ``size`` characters, repeat at most ``overlap``, and their new
    parts joined give the text back.  A text of at most ``size`` characters is one piece.
    """
    if overlap >= size or least >= size - overlap:
        raise ValueError("overlap and least must leave room in size")
    n = len(text)
    if n <= size:
        return [(0, 0, n)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = landmarks(points).tolist()
    kinds = [k.tolist() for k in boundaries(points)]
    words = kinds[3]
    out, start, new = [], 0, 0
    while True:
        most = start + size
        if most >= n:
            out.append((start, new, n))
            return out
        low = new + least
        i = bisect_left(marks, low)
        target = marks[i] if i < len(marks) and marks[i] <= most else most
        end = None
        for places in kinds:
            if (end := _nearest(places, target, max(low, target - NEAR), min(most, target + NEAR))) is not None:
                break
        if end is None:
            end = _nearest(words, target, low, most)
        if end is None and (j := bisect_right(words, low) - 1) >= 0 and words[j] > new:
            end = words[j]
        if end is None:
            end = target
            while end > new + 1 and _joined(text, end):
                end -= 1
        out.append((start, new, end))
        new, first = end, max(end - overlap, start + 1)
        start = end
        for places in (kinds[2], words):
            j = bisect_left(places, first)
            if j < len(places) and places[j] < end:
                start = places[j]
                break
        else:
            if overlap and not _joined(text, first):
                start = first


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part a character from its marks."""
    import unicodedata

    return at < len(text) and (unicodedata.category(text[at])[0] == "M" or text[at] == "‍" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n")


def pieces(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Each text as ordered pieces: rec_kind, rec_id, n_chars, n_pieces, piece_no (from 1), start, new, end, text.

    ``start``, ``new`` and ``end`` are offsets in characters.  Short texts are one piece;
    null and empty texts have none.  Nothing is shuffled.
    """
    schema = pa.schema([("rec_kind", pa.string()), ("rec_id", pa.string()), *((c, pa.int32()) for c in ("n_chars", "n_pieces", "piece_no", "start", "new", "end")), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for piece in sliced(batch, "text"):
                cols: list[list] = [[] for _ in schema]
                for kind, key, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    if not text:
                        continue
                    cut = spans(text, size, overlap)
                    for no, (a, m, z) in enumerate(cut, 1):
                        for col, v in zip(cols, (kind, key, len(text), len(cut), no, a, m, z, text[a:z]), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "rec_kind string, rec_id string, n_chars int, n_pieces int, piece_no int, `start` int, `new` int, `end` int, text string"
    return items.select("rec_kind", "rec_id", "text").mapInArrow(run, ddl)
