"""Byte-level BPE by a pair occurrence index, on the files of public tokenizers.

A partition's texts are cut into words by the public pattern (vectorised over code
points).  Words not met before by this worker go through the index together: every
adjacent pair of symbols that has a merge rank is filed under that rank with all its
positions; ranks are taken in ascending order, each applied to all its positions from
left to right, and the lists of the neighbouring pairs are updated.  A word's ids are
kept, so a word is merged once per worker and not once per occurrence.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

TOKENIZERS = os.environ.get("GLEANERY_TOKENIZERS", "/opt/tokenizers")
#: A worker forgets its words beyond this number; it changes no result.
WORDS_KEPT = 400_000

LETTER, NUMBER, SPACE, OTHER, EDGE = 1, 2, 3, 4, 0

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Letter, number, space or other for each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, each followed by one line feed; their code points; the positions of those line feeds."""
    joined = "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return joined, points, ends


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of the public byte-level pattern start; the ends of texts count as words of their own."""
    c = classes()[points]
    c[ends] = EDGE
    before = np.concatenate(([EDGE], c[:-1]))
    after = np.concatenate((c[1:], [EDGE]))
    plain = np.concatenate(([False], points[:-1] == 0x20)) & (before == SPACE)
    solid = (c != SPACE) & (c != EDGE)
    start = (c == EDGE) | (solid & (before != c) & ~plain)
    start |= (c == SPACE) & ((before != SPACE) | ((after != SPACE) & (after != EDGE)))
    marks = np.flatnonzero((points == 0x27) & (c == OTHER) & (before != OTHER) & (after == LETTER) & ~plain)
    if marks.size:  # 's 't 'm 'd 're 've 'll
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, len(points) - 1)]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        start[marks[short | long] + 1] = False
        for hit, n in ((marks[short], 2), (marks[long & ~short], 3)):
            rest = hit + n
            start[rest[c[rest] == LETTER]] = True
    return np.flatnonzero(start)


class _Index(dict):
    """Numbers words in the order they come."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class ByteBpe:
    """The byte-level vocabulary of one tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes the file writes as themselves
        rest = [b for b in range(256) if b not in set(shown)]
        signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first = np.array([vocab[signs[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.merged)}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        byte = {s: b for b, s in signs.items()}
        self.partial = np.zeros(max(vocab.values()) + 1, bool)  # tokens that are no whole characters
        for text, i in vocab.items():
            try:
                bytes(byte[s] for s in text).decode()
            except (UnicodeDecodeError, KeyError):
                self.partial[i] = True
        self.forget()

    def forget(self) -> None:
        self.words = _Index()
        self.lengths, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and the number of ids of each."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        gaps = np.cumsum(sizes + 1) - 1
        symbols = self.first[raw]
        symbols[gaps] = -1
        left, right = symbols[:-1], symbols[1:]
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == key)
        ranks = self.ranks[at[found]]
        order = np.argsort(ranks, kind="stable")
        found, ranks = found[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(r[0]): p.tolist() for r, p in zip(np.split(ranks, cuts), np.split(found, cuts))} if len(found) else {}
        active = list(index)
        heapq.heapify(active)
        s, after, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        s.append(-1)
        rank_of, merged = self.rank.get, self.merged
        while active:
            r = heapq.heappop(active)
            a, b, new = merged[r]
            where = index.pop(r)
            where.sort()
            for p in where:
                q = after[p]
                if s[p] != a or s[q] != b:
                    continue
                s[p], s[q] = new, -2
                n = after[p] = after[q]
                if n < len(before):
                    before[n] = p
                for at_, x, y in ((before[p], s[before[p]] if before[p] >= 0 else -1, new), (p, new, s[n])):
                    if x >= 0 and y >= 0 and (k := rank_of(x << 20 | y)) is not None:
                        if k in index:
                            index[k].append(at_)
                        else:
                            index[k] = [at_]
                            heapq.heappush(active, k)
        done = np.array(s[:-1], np.int64)
        word = np.repeat(np.arange(len(words)), sizes + 1)
        alive = done >= 0
        return done[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))

    def numbered(self, words: list[str]) -> np.ndarray:
        """The number of each word in this worker's pool; new words are merged."""
        if len(self.words) > WORDS_KEPT:
            self.forget()
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if new := self.words.new:
            self.words.new = []
            ids, lengths = self.merge(new)
            offsets = len(self.pool) + np.cumsum(lengths) - lengths
            word = np.repeat(np.arange(len(new)), lengths)
            self.parts = np.concatenate((self.parts, np.bincount(word, self.partial[ids], len(new)).astype(np.int64)))
            self.pool = np.concatenate((self.pool, ids))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.offsets = np.concatenate((self.offsets, offsets))
        return out

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts and the number of words of each."""
        joined, points, ends = code_points(texts)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = word_starts(points, ends)
        stops = np.append(starts[1:], len(points))
        of = np.searchsorted(ends, starts)
        real = starts != ends[np.minimum(of, len(ends) - 1)]
        words = [joined[a:b] for a, b in zip(starts[real].tolist(), stops[real].tolist())]
        return self.numbered(words), np.bincount(of[real], minlength=len(texts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        words, counts = self._cut(texts)
        lengths = self.lengths[words]
        total = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        ids = self.pool[np.repeat(self.offsets[words] - starts, lengths) + np.arange(total)]
        per_text = np.add.reduceat(np.append(lengths, 0), np.minimum(np.cumsum(counts) - counts, len(lengths)))
        return ids, np.where(counts > 0, per_text, 0)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        words, counts = self._cut(texts)
        lengths = np.append(self.lengths[words], 0)
        return np.where(counts > 0, np.add.reduceat(lengths, np.minimum(np.cumsum(counts) - counts, len(lengths) - 1)), 0)


@lru_cache(4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str | None = None) -> ByteBpe:
    """The tokenizer of one file, loaded once per worker."""
    return ByteBpe(f"{folder or TOKENIZERS}/{name}.json")
