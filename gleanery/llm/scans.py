"""Repair of texts read from scanned pages.

Running headers and footers are found by fuzzy repetition of lines at page edges, page
numbers by their sequence; then lines are joined, and broken and misread words restored
where the whole corpus knows the restored word and hardly the damaged one.  Texts without
such traces stay as they are.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.storage import shared_table

#: A word is common at this share of all words and at least so many occurrences; what is rarer is no word by itself.
SHARE, LEAST = 2e-6, 3
#: A restored word must occur so many times, and so many times as often as the damaged one.
KNOWN, RATIO = 5, 25
FUZZY = 0.72

#: A confusion is learned from so many damaged words, and where the opposite one has this many times fewer.
LEARNED, ONE_WAY = 6, 20
#: An ending of this share of the frequent words is an ending of the language, not a misreading at a word's end.
ENDING = 0.01

# What scanners commonly read for what, for vocabularies too small to learn from, and signs that stand for letters.
HANGUL_READ = dict(zip("디핟게무온논울률외가오르판지괴시줄섬", "다한계부은는을를의기으로관자과사출성", strict=True))
LATIN_READ = [("c", "e"), ("f", "t"), ("q", "g"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("6", "é")]
SIGNS_READ = [("@", "a"), ("!", "i"), ("|", "l")]
DIGIT_READ = str.maketrans("OolISB", "001158")
STRAY = "`^~|;'·"

_SOFT = re.compile("­(?![ \\t]*\\n)")  # a soft hyphen that ends no line
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"([^\W\d_]+)([-‐‑¬­])[ \t]*$")
_HYPHENS, _CLOSED, _LAST = "-‐‑¬­", ".!?,:;)]}", re.compile(r"[^\W_]+$")
_PAGE = [  # (name, pattern, whether one line of it is enough)
    ("dashes", re.compile(r"[-—–]\s*(\d{1,4})\s*[-—–]"), True),
    ("angles", re.compile(r"[〈<《]\s*(\d{1,4})\s*[〉>》]"), True),
    ("words", re.compile(r"(?:제\s*(\d{1,4})\s*(?:쪽|페이지|면)|(?:p\.|pp\.|page|페이지)\s*(\d{1,4}))", re.I), True),
    ("of", re.compile(r"(?:page|p\.)\s*(\d{1,4})\s*(?:of|sur|/|de)\s*\d{1,4}", re.I), True),
    ("square", re.compile(r"[\[(]\s*(\d{1,4})\s*[\])]"), False),
    ("slash", re.compile(r"(\d{1,4})\s*/\s*\d{1,4}"), False),
    ("bar", re.compile(r"(\d{1,4})\s*\|\s*\d{1,4}"), False),
    ("bare", re.compile(r"(\d{1,4})"), False),
]


_MAYBE = re.compile(rf"[\f \t{re.escape(STRAY)}]*(?:[-—–〈<《\[(]|제|pp?\.|page|페이지|[\dOolISB])", re.I)
_NOISE = re.compile(rf"[{re.escape(STRAY.replace('|', ''))}]")
_FIGURES = re.compile(r"(?<![A-Za-z가-힣])[\dOolISB]+(?![a-zA-Z가-힣])")


def _spellings(text: str) -> Iterator[str]:
    """The line as it is, without stray marks, and with letters read as figures."""
    yield text
    clean = _NOISE.sub("", text).strip()
    yield clean
    yield _FIGURES.sub(lambda m: m[0].translate(DIGIT_READ), clean)


def _number(line: str) -> tuple[str, int, bool] | None:
    """The form and number of a line that can only be a page number."""
    if len(line) > 40 or not _MAYBE.match(line):
        return None
    text = line.strip("\f \t\r")
    if len(text) > 24:
        return None
    for clean in _spellings(text):
        for name, pattern, enough in _PAGE:
            if m := pattern.fullmatch(clean):
                return name, int(next(g for g in m.groups() if g)), enough
    return None


def page_numbers(lines: list[str]) -> set[int]:
    """The lines that number pages: forms that say so, others in a rising sequence."""
    found: dict[str, list[tuple[int, int]]] = {}
    out: set[int] = set()
    for i, line in enumerate(lines):
        if n := _number(line):
            if n[2] and sum(bool(x.strip()) for x in lines) > 1:
                out.add(i)
            else:
                found.setdefault(n[0], []).append((i, n[1]))
    for name, rows in found.items():
        if name == "bare":  # three figures one below the other are a column
            at = {i for i, _ in rows}
            rows = [(i, n) for i, n in rows if not ({i - 1, i - 2} <= at or {i - 1, i + 1} <= at or {i + 1, i + 2} <= at)]
        edge = [i for i, _ in rows if "\f" in "".join(lines[i : i + 2]) or lines[i].startswith("\f")]
        good: set[int] = set()
        for (i, a), (j, b) in zip(rows, rows[1:]):
            if b - a == 1 or (b - a == 2 and name != "bare"):
                good |= {i, j}
        if name == "bare":  # a sequence needs text between its numbers, or three of them
            rising = [r for r in rows if r[0] in good]
            if len(rising) < 3 and not any(j - i > 2 for (i, _), (j, _) in zip(rising, rising[1:])) and not edge:
                good = set()
        if not all(b > a for (_, a), (_, b) in zip(rows, rows[1:])) and name in ("bare", "square") and not edge:
            good = set()
        out |= good | set(edge)
    return out


_REST = re.compile(r"\W+")


def _plain(line: str) -> str:
    line = line.lower()
    for sign in "oli1|!":
        line = line.replace(sign, "0")
    return _REST.sub("", line)


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or min(len(a), len(b)) * 2 < max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= FUZZY and m.quick_ratio() >= FUZZY and m.ratio() >= FUZZY


class _Keys:
    """Keys with which a line is compared all at once.

    Matching blocks are a common subsequence, so the longest one bounds the ratio from
    above: keys that it rules out need no comparison, and no other is left out.  Its
    length comes from bit operations on all keys of a block, laid side by side.
    """

    BLOCK = 256

    def __init__(self, keys: list[str]) -> None:
        self.blocks = []
        for start in range(0, len(keys), self.BLOCK):
            part = keys[start : start + self.BLOCK]
            width = max(map(len, part)) // 8 + 1  # bytes of a key, with a bit for the carry
            marks: dict[str, bytearray] = {}
            for n, key in enumerate(part):
                for at, c in enumerate(key, n * width * 8):
                    if c not in marks:
                        marks[c] = bytearray(len(part) * width)
                    marks[c][at >> 3] |= 1 << (at & 7)
            bits = {c: int.from_bytes(m, "little") for c, m in marks.items()}
            full = 0
            for m in bits.values():
                full |= m
            self.blocks.append((start, width, np.array([len(k) for k in part]), bits, full))

    def like(self, key: str) -> list[int]:
        """The keys that may be alike, in order."""
        out: list[int] = []
        for start, width, sizes, bits, full in self.blocks:
            v = full
            for c in key:
                if u := v & bits.get(c, 0):
                    v = ((v + u) | (v - u)) & full
            left = np.bitwise_count(np.frombuffer(v.to_bytes(len(sizes) * width, "little"), np.uint8)).reshape(-1, width).sum(axis=1, dtype=np.int64)
            out += (start + np.flatnonzero(2 * (sizes - left) >= FUZZY * (sizes + len(key)) - 1e-6)).tolist()
        return out


def _groups(lines: list[str], fit: list[int], active: set[int], plain: dict[int, str] | None = None) -> tuple[list[list[int]], list[str]]:
    """Lines by the first line that they are like, and the keys of those; every line is compared with all of them.

    Only groups with a line of ``active`` count, so where none of these is like another
    line, each line is a group of its own.
    """
    plain = plain or {i: _plain(lines[i]) for i in fit}
    times = Counter(plain[i] for i in fit)
    distinct = list(times)
    number = {k: n for n, k in enumerate(distinct)}
    asked = {plain[i] for i in fit if i in active}
    alone = [[i] for i in fit], [plain[i] for i in fit]
    if not asked or len(fit) < 2:
        return alone
    known = _Keys(distinct)
    if all(times[k] == 1 for k in asked) and not any(n != number[k] for k in asked for n in known.like(k)):
        return alone
    groups: dict[int, list[int]] = {}
    head: dict[str, int] = {}
    for i in fit:
        key = plain[i]
        if key not in head:
            head[key] = next((n for n in known.like(key) if n in groups and _alike(key, distinct[n])), number[key])
        groups.setdefault(head[key], []).append(i)
    return list(groups.values()), [distinct[n] for n in groups]


def _ended(line: str) -> bool:
    """Whether a line ends a sentence, or calls for another one."""
    return line.rstrip().rstrip("\"'”’)]")[-1:] in tuple(".!?:;。…")


_ITEM = re.compile(r"^\s*(?:[-*•○●▶※◦□■·]\s|\(?\d{1,3}[.)]\s|[가-하][.)]\s|[①-⑳]|제\s*\d+\s*[장절조]|section\s+\d|\[[^\]\n]+\]\s*$|\||#|```|[{}<])", re.I)


def running_lines(lines: list[str], numbers: set[int]) -> set[int]:
    """Headers and footers: lines that recur, nearly the same, beside page breaks or within sentences."""
    filled = [i for i, x in enumerate(lines) if x.strip("\f \t\r")]
    place = {i: k for k, i in enumerate(filled)}
    breaks = {i for i in filled if i in numbers or lines[i].startswith("\f")} | {i for i in filled if any(lines[j].startswith("\f") and not lines[j].strip("\f \t\r") for j in range(max(0, i - 1), min(len(lines), i + 2)))}
    near: set[int] = set()
    for i in breaks:
        for k in range(place[i] - 2, place[i] + 3):
            if 0 <= k < len(filled):
                near.add(filled[k])
    plain = {i: _plain(lines[i]) for i in filled if i not in numbers and 3 <= len(lines[i].strip("\f \t\r")) <= 90 and not lines[i].rstrip().endswith(("다.", "요."))}
    fit = [i for i, key in plain.items() if len(key) >= 2]
    groups, keys = _groups(lines, fit, near | {i for i in fit if i not in near and _interrupts(lines, filled, place[i], numbers) and not re.match(r"[a-zà-ÿ]", lines[i].strip("\f \t"))}, plain)
    out: set[int] = set()
    for g, key in zip(groups, keys):
        barred = bool(re.fullmatch(r"\s*==\s.*\s==\s*", lines[g[0]].strip("\f")))
        edge = [i for i in g if i in near]
        apart = all(place[b] - place[a] > 1 for a, b in zip(g, g[1:]))
        if len(g) > 1 and apart and not any(_ITEM.match(lines[i]) and not barred and not re.fullmatch(r"\s*\[[^\]]+\]\s*", lines[i]) for i in g):
            inner = [i for i in g if _interrupts(lines, filled, place[i], numbers | set(g)) and not re.match(r"[a-zà-ÿ]", lines[i].strip("\f \t"))]
            same = len(inner) >= 2 and (len(key) >= 8 or len(g) > 3) and SequenceMatcher(None, plain[inner[0]], plain[inner[1]], autojunk=False).ratio() >= 0.85
            if len(edge) >= 2 or (edge and inner) or same or (inner and barred):
                title = g[0] if place[g[0]] <= 1 and len(g) > 1 and g[0] not in near and len(key) > 12 and not lines[g[0]].startswith("\f") else None
                out |= set(g) - {title}
        elif barred and (edge or len(filled) > 1):
            out |= set(g)
    head = next((i for i in filled if i not in numbers), None)
    if head is not None:  # a title that comes again cut short
        whole = _plain(lines[head])
        for i in fit:
            k = plain[i]
            if i != head and i not in out and len(k) >= 8 and len(k) < len(whole) and (whole.endswith(k) or whole.startswith(k)) and (i in near or _interrupts(lines, filled, place[i], numbers) and not re.match(r"[a-zà-ÿ]", lines[i].strip("\f \t"))):
                out.add(i)
    return out


def _interrupts(lines: list[str], filled: list[int], k: int, skip: set[int]) -> bool:
    """Whether a sentence goes on from before this line to after it."""
    a = next((filled[j] for j in range(k - 1, -1, -1) if filled[j] not in skip), None)
    b = next((filled[j] for j in range(k + 1, len(filled)) if filled[j] not in skip), None)
    if a is None or b is None:
        return False
    before, after = lines[a].rstrip(), lines[b].lstrip("\f \t")
    return len(before) > 15 and not _ended(before) and not _ITEM.match(after) and not _ITEM.match(before) and bool(re.match(r"[a-zà-ÿ가-힣(]", after))


class Counts:
    """Exact counts of all words, in two mapped files: sorted hashes, and counts in the same order."""

    def __init__(self, hashes: str, counts: str) -> None:
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.hashes, self.counts = (np.asarray(np.memmap(f, np.int64, "r")) if Path(f).stat().st_size else np.zeros(0, np.int64) for f in (hashes, counts))
        self.size = 1 << max(16, min(24, (len(self.hashes) * 16).bit_length()))
        some = np.zeros(self.size, np.uint8)  # whether any word's hash ends so: spares most searches
        for i in range(0, len(self.hashes), 1 << 20):
            some[self.hashes[i : i + (1 << 20)] & (self.size - 1)] = 1
        self.some = some.tobytes()

    def get(self, word: str, default: int = 0) -> int:
        h = self.hash(word.encode("utf-8", "surrogatepass"), 42)
        if not self.some[h & (self.size - 1)]:
            return default
        h = h - (1 << 64) if h >= 1 << 63 else h
        i = int(self.hashes.searchsorted(h))
        return int(self.counts[i]) if i < len(self.hashes) and self.hashes[i] == h else default


class Reader:
    """Restores words by the corpus vocabulary and by confusions (read, meant): those of its corpus, or where none are given the common ones."""

    def __init__(self, vocabulary: dict[str, int] | Counts, common: float = LEAST, learned: list[tuple[str, str]] | None = None) -> None:
        self.count = lambda w: vocabulary.get(w, 0)
        self.common = lambda w: self.count(w) >= common
        self.kept: dict[str, tuple[str, bool] | None] = {}
        self.sound: set[str] = set()  # words met that need no repair
        self.hangul: dict[str, list[str]] = {}
        self.latin = list(SIGNS_READ)
        for read, meant in [*HANGUL_READ.items(), *LATIN_READ] if learned is None else learned:
            if "가" <= read <= "힣":
                self.hangul.setdefault(read, [])
                self.hangul[read] += [meant] if meant not in self.hangul[read] else []
            elif (read, meant) not in self.latin:
                self.latin.append((read, meant))

    def better(self, new: str, old: str) -> bool:
        n = self.count(new)
        return n >= KNOWN and n >= RATIO * self.count(old)

    def word(self, w: str) -> tuple[str, bool] | None:
        """The restored form of a damaged word, and whether signs or figures within letters prove the damage."""
        if w not in self.kept:
            if len(self.kept) > 300_000:
                self.kept.clear()
            self.kept[w] = self._word(w)
        return self.kept[w]

    def _word(self, w: str) -> tuple[str, bool] | None:
        low = w.lower()
        if len(low) > 40 and not re.search(r"[가-힣]", low):
            return None
        best: tuple[int, str] | None = None
        if re.search(r"[가-힣]", low):
            options = {low}
            if "0|" in low:
                options = {low.replace("0|", "이")}
            for _ in range(2):
                options |= {o[:i] + m + o[i + 1 :] for o in list(options) for i, c in enumerate(o) for m in self.hangul.get(c, ())}
                if len(options) > 60:
                    break
        else:
            if len(low) < 3 or low.isdigit():
                return None
            options = {low}
            for _ in range(3):
                more = set()
                for o in options:
                    for a, b in self.latin:
                        at = o.find(a)
                        while at >= 0:
                            more.add(o[:at] + b + o[at + len(a) :])
                            at = o.find(a, at + 1)
                if any(self.better(o, low) for o in more) or len(more) > 150:
                    options |= more
                    break
                options |= more
        for o in options - {low}:
            if self.better(o, low) and (best is None or self.count(o) > best[0]):
                best = (self.count(o), o)
        if best is None:
            return None
        new = best[1]
        if w[:1].isupper():
            new = new[:1].upper() + new[1:]
        return new, bool(re.search(r"[@!|]|(?<=[^\W\d_])\d+(?=[^\W\d_])|^\d(?=[a-z]{3})|0\|", low))


_SIGNED = re.compile(r"[^\W_]*(?:(?<=[^\W_])[@!|`^~;·]|(?<=[가-힣\d])'(?=[가-힣]))(?:[^\W_]+[@!|`^~;·']?)+|[@!|][^\W_]{2,}")
_SIGN = re.compile(r"[@!|`^~;·](?=[^\W_])|(?<=[가-힣\d])'(?=[가-힣])")
_DAMAGED_FIGURE = re.compile(r"(?<![\w.,-])(?=[\d,.]*[lOSB])(?=[lOSB,.]*\d)[\dlOSB]+(?:[.,][\dlOSB]+)*(?=일|개|쪽|명|년|월|시|분|초|차|건|종|회|조|원|곳|%|\.\s|\s|$)")
_SOME_FIGURE = re.compile(r"\d[lOSB]|[lOSB][\d,]")


def damaged_words(text: str, reader: Reader) -> tuple[dict[str, str], int, int]:
    """Replacements, and the numbers of sure and of possible misreadings."""
    swaps: dict[str, str] = {}
    sure = maybe = 0
    odd = set(_WORD.findall(text.lower())) - reader.sound
    hurt = set()
    for w in odd:
        if reader.word(w) is None:
            if len(reader.sound) < 500_000:
                reader.sound.add(w)
        else:
            hurt.add(w)
    if hurt:
        for token, n in Counter(t for t in _WORD.findall(text) if t.lower() in hurt).items():
            if got := reader.word(token):
                swaps[token] = got[0]
                sure, maybe = sure + n * got[1], maybe + n * (not got[1])
    if _SIGN.search(text):
        for token, n in Counter(_SIGNED.findall(text)).items():
            parts = [p.lower() for p in _WORD.findall(token)]
            bare = re.sub(rf"[{re.escape(STRAY)}]", "", token)
            whole = reader.count(bare.lower())
            if bare != token and whole >= KNOWN and min(map(reader.count, parts)) * RATIO <= whole:
                swaps[token] = bare
                maybe += n
                sure += n * bool(re.search(r"[가-힣][`^~|;'][가-힣]", token))
            elif re.search(r"[@!]|0\|", token) and (got := reader.word(token.rstrip(STRAY))):
                swaps[token.rstrip(STRAY)] = got[0]
                sure += n
    if _SOME_FIGURE.search(text):
        for f in {m[0] for m in _DAMAGED_FIGURE.finditer(text)}:
            swaps[f] = f.translate(DIGIT_READ)
            maybe += 1
    return swaps, sure, maybe


def joins(lines: list[str], reader: Reader) -> tuple[list[tuple[int, str]], int, int]:
    """For lines that end within a word: (line, what the break becomes); sure and possible breaks."""
    out, sure, maybe = [], 0, 0
    for i in range(len(lines) - 1):
        a, b = lines[i].rstrip(" \t\r"), lines[i + 1].lstrip("\f")
        if not a or not b or not b[0].isalpha() or a[-1] in _CLOSED:
            continue
        r = _WORD.match(b)[0]
        if a[-1] in _HYPHENS and (m := _BREAK.search(lines[i])):
            left = m[1]
            whole = (left + r).lower()
            if reader.count(whole) >= KNOWN and reader.count(whole) * 4 >= min(reader.count(left.lower()), reader.count(r.lower())) or (got := reader.word(whole)) is not None and got:
                out.append((i, ""))
                sure += 1
            elif re.search(r"[가-힣]$", left) and re.match(r"[가-힣]", r) or m[2] in "‐¬­":
                out.append((i, ""))
                sure += m[2] != "-" or not (reader.common(left.lower()) and reader.common(r.lower()))
                maybe += 1
            elif reader.common(left.lower()) and reader.common(r.lower()):
                out.append((i, "-"))  # a hyphen of its own
            else:
                out.append((i, ""))
                maybe += 1
            continue
        left = _LAST.search(a) if a[-1].isalnum() else None
        if left and not left[0].isdigit():
            whole, x, y = (left[0] + r).lower(), reader.count(left[0].lower()), reader.count(r.lower())
            n = reader.count(whole)
            if n >= KNOWN and n >= RATIO * min(x, y) and (re.search("[가-힣]", whole) or n >= RATIO * max(min(x, y), 1)):
                out.append((i, "")) 
                if not (reader.common(left[0].lower()) and reader.common(r.lower())) or n >= 200 * min(x, y):
                    sure += 1
                else:
                    maybe += 1
    return out, sure, maybe


def repair(text: str, reader: Reader) -> tuple[str, dict[str, int]] | None:
    """The text as continuous paragraphs and the numbers of its traces; None where it has none."""
    lines = re.sub(r"\f(?!\n)", "\n\f", text).split("\n") if "\f" in text else text.split("\n")
    numbers = page_numbers(lines) if len(lines) > 1 else set()
    running = running_lines(lines, numbers) if len(lines) > 2 else set()
    kept = [(i, x) for i, x in enumerate(lines) if i not in numbers and i not in running and x.strip("\f \t\r") or not x and i - 1 not in numbers | running]
    body = [x.lstrip("\f") for _, x in kept]
    solid = [x for x in body if x.strip()]
    cut, sure_b, maybe_b = joins(solid, reader) if len(solid) > 1 else ([], 0, 0)
    swaps, sure_w, maybe_w = damaged_words(text, reader)
    traces = {"page_numbers": len(numbers), "running_lines": len(running), "broken_words": sure_b, "misread_words": sure_w, "possible": maybe_b + maybe_w}
    if not (numbers or running or sure_b or sure_w or maybe_b + maybe_w >= 2):
        return None
    ends = dict(cut)
    width = sorted(map(len, solid))[int(len(solid) * 0.9)] if solid else 0
    out: list[str] = []
    k, open_ = -1, None  # open_: what stands between the last line and the next one, if they are one paragraph
    for x in body:
        if not x.strip():
            if open_ is None and out and out[-1]:
                out.append("")
            continue
        k += 1
        line = x.strip(" \t\r")
        if open_ is not None and out and not (_ITEM.match(line) and open_ == " "):
            if out[-1] == "":
                out.pop()
            out[-1] += open_ + line
        else:
            out.append(line)
        if k in ends:
            m = _BREAK.search(out[-1])
            out[-1] = out[-1][: m.end(1)] + ends[k] if m else out[-1]
            open_ = ""
        else:
            open_ = " " if len(line) >= 0.6 * width and not (_ended(line) and len(line) < 0.8 * width) and len(line) > 12 else None
    made = "\n".join(out).strip("\n")
    if swaps:
        made = re.sub("|".join(rf"(?<!\w){re.escape(w)}(?!\w)" for w in sorted(swaps, key=len, reverse=True)), lambda m: swaps[m[0]], made)
    return made, traces


def vocabulary(items: DataFrame) -> tuple[DataFrame, int]:
    """(word, n): all words of all texts, in lower case, with their exact counts; and the number of all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(_WORD.findall(text.lower()))
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
        yield flush()

    counts = items.select("text").mapInArrow(run, "word string, n bigint").where("length(word) <= 40").groupBy("word").agg(F.sum("n").alias("n"))
    counts = shared_table(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts, total


def confusions(counts: DataFrame) -> list[tuple[str, str]]:
    """(read, meant): characters, or two Latin letters, that stand for another one in damaged words of the corpus.

    A word is held against words that differ from it in that one place and are RATIO times
    as frequent; Latin ones must share four letters.  A pair of readings recurs in many words and hardly the other way round;
    of several meanings of one word's reading the pair that recurs most counts.  Endings of
    the language are no misreadings at a word's end.  What comes to the driver is bounded
    by the pairs of characters in use, some hundreds.
    """
    words = counts.where(F.col("word").rlike("^(?:[가-힣]{2,40}|[a-zà-ÿ]*[0-9]?[a-zà-ÿ]*)$") & (F.length("word") >= 2) & F.col("word").rlike("[a-zà-ÿ가-힣]"))
    frequent = words.where((F.col("n") >= KNOWN * RATIO // 5) & ~F.col("word").rlike("[0-9]"))
    place = "transform(sequence(1, length(word) - {k}), i -> named_struct('key', concat(left(word, i - 1), '\u0001', substring(word, i + {m})), 'c', substring(word, i, {m}), 'end', i = length(word)))"
    one, two = F.expr(place.format(k=0, m=1)), F.expr(place.format(k=1, m=2))
    meant = frequent.select(F.explode(one).alias("x"), F.col("n").alias("m")).select("x.key", F.col("x.c").alias("meant"), "m")
    latin = F.col("word").rlike("^[a-zà-ÿ]{3,}$")
    read = words.select("word", "n", F.explode(F.when(latin, F.concat(one, two)).otherwise(one)).alias("x")).select("word", "n", "x.key", F.col("x.c").alias("read"), "x.end").where("length(key) > 4 OR key RLIKE '[가-힣]'")
    endings = frequent.where("length(word) > 2").groupBy(F.right("word", F.lit(1)).alias("read")).agg(F.count(F.lit(1)).alias("k"))
    usual = endings.crossJoin(F.broadcast(endings.agg(F.sum("k").alias("all")))).where(F.col("k") >= ENDING * F.col("all")).select("read", F.lit(True).alias("end"))  # one row of a total
    pairs = read.join(meant, "key").where((F.col("m") >= RATIO * F.col("n")) & (F.col("read") != F.col("meant")))
    pairs = shared_table(pairs.join(F.broadcast(usual), ["read", "end"], "left_anti").select("word", "read", "meant").distinct())  # at most 1 / ENDING endings
    first = pairs.groupBy("read", "meant").agg(F.count(F.lit(1)).alias("k"))
    best = pairs.join(first, ["read", "meant"]).groupBy("word", "read").agg(F.max_by("meant", F.struct("k", "meant")).alias("meant"))
    own = best.groupBy("read", "meant").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEARNED)
    back = first.select(F.col("meant").alias("read"), F.col("read").alias("meant"), F.col("k").alias("back"))
    kept = own.join(back, ["read", "meant"], "left").where(F.coalesce("back", F.lit(0)) * ONE_WAY <= F.col("k"))
    return sorted((r["read"], r["meant"]) for r in kept.select("read", "meant").collect())


def _shipped(counts: DataFrame) -> tuple[str, str]:
    """Names of the files of hashes and counts, which every executor fetches once and maps.

    A word takes 16 bytes, and one partition at a time passes through the driver, so
    neither the driver nor a worker holds the table.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c, np.int64).tobytes()], pa.binary()) for c in batch.columns], ["h", "n"])

    folder = Path(tempfile.mkdtemp(prefix="gleanery-words-"))
    atexit.register(shutil.rmtree, folder, True)
    name = uuid.uuid4().hex
    hashes, ns = folder / f"{name}.hashes", folder / f"{name}.counts"
    packed = counts.select(F.xxhash64("word").alias("h"), "n").orderBy("h").mapInArrow(pack, "h binary, n binary")
    with hashes.open("wb") as a, ns.open("wb") as b:
        for row in packed.toLocalIterator():
            a.write(row["h"])
            b.write(row["n"])
    for f in (hashes, ns):
        counts.sparkSession.sparkContext.addFile(str(f))
    return hashes.name, ns.name


_KEPT: dict[str, Reader] = {}


def _reader(hashes: str, counts: str, common: float, learned: list[tuple[str, str]]) -> Reader:
    """The worker's reader, kept from task to task."""
    if hashes not in _KEPT:
        _KEPT.clear()
        _KEPT[hashes] = Reader(Counts(SparkFiles.get(hashes), SparkFiles.get(counts)), common, learned)
    return _KEPT[hashes]


def repaired(items: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, scanned, page_numbers, running_lines, broken_words, misread_words, text).

    ``scanned`` says that the text has traces of page scanning; only then it is changed.
    Null, empty and one-word texts are never scanned and stay as they are.
    """
    counts, total = vocabulary(items)
    hashes, ns = _shipped(counts)
    common = max(LEAST, total * SHARE)
    learned = confusions(counts)
    names = ["page_numbers", "running_lines", "broken_words", "misread_words"]
    schema = pa.schema([("rec_kind", pa.string()), ("rec_id", pa.string()), ("scanned", pa.bool_()), *((n, pa.int32()) for n in names), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        from gleanery.llm.canonical import alike, invisible, sliced
        from gleanery.llm.scans import _reader  # the module's own, else each task has a copy

        table = {ord(k): v for k, v in alike().items() if k not in "｜"} | {c: None for c in invisible() if c != 0xAD}
        reader = _reader(hashes, ns, common, learned)
        unusual = re.compile(r"[^\x09-\x7e\xa1-\xac\xae-\xff가-힣]")
        for batch in batches:
            for piece in sliced(batch, "text"):
                kinds, keys, texts = (piece.column(i).to_pylist() for i in range(3))
                flags, traces, out = [], [], []
                for text in texts:
                    plain = _SOFT.sub("", text).translate(table) if text and unusual.search(text) else text
                    got = repair(plain, reader) if text else None
                    flags.append(got is not None)
                    traces.append(got[1] if got else dict.fromkeys(names, 0))
                    out.append(got[0] if got else text)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(flags), *(pa.array([t[n] for t in traces], pa.int32()) for n in names), pa.array(out, pa.string())], schema=schema)

    return items.select("rec_kind", "rec_id", "text").mapInArrow(run, "rec_kind string, rec_id string, scanned boolean, page_numbers int, running_lines int, broken_words int, misread_words int, text string")
