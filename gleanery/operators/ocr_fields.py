"""From read pages to fields: labelled blocks, tables in HTML, key and value lines, review tables, footnotes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.pages import html_layout

# Markers of items, names of columns and fields, labels of blocks.
ITEM = re.compile(r"^\s*([①②③④⑤⑥⑦⑧⑨⑩]|\d+[.)]|[•·\-])\s*")
REVIEW_ITEM = re.compile(r"^\s*([①②③④⑤⑥⑦⑧⑨⑩]|\d+[.)])\s*")
DURATION = re.compile(r"(\d+\s*(?:개월|년|월|주|일)(?:간)?)")
FULL_DATE = re.compile(r"\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일")
KEY_VALUE = re.compile(r"^\s*([^:：]{2,40})\s*[:：]\s*(.+)$")
HEADER_WORDS, HEADER_HINT = ("항목", "의견", "구분", "내용"), re.compile("항목|의견|구분|내용|기간|비고|번호|구성")
ITEM_NAMES, OPINION_NAMES, PERIOD_NAMES = [("검토", "항목"), ("구분",), ("항목",)], [("검토", "의견"), ("의견",), ("내용",)], [("사업", "기간"), ("추정", "기간"), ("기간",)]
ITEM_FIELD, OPINION_FIELD, PERIOD_FIELD, TITLE_FIELD, DATE_FIELD, TO_FIELD = "검토항목", "검토의견", "추정 사업기간", "문서명", "작성일", "수신"
PERIOD_LABEL = re.compile("기간|일정")
META_LABELS = set("table text number footnote header header_image footer footer_image aside_text".split())
SEPARATOR = "#################"
RANK = {"direct_cell": 3, "inferred_token": 2, "carried_forward": 1, "empty": 0}


def _line(value: object) -> str:
    return " ".join(str(value or "").split())


def _compact(value: object) -> str:
    return re.sub("[^0-9a-z가-힣]+", "", str(value or "").lower())


def _without_tags(html: str) -> str:
    import html as h

    return _line(h.unescape(re.sub("<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>", "\n", html))))


def duration(text: str) -> str:
    """The last duration of a text; days are no duration where a full date stands."""
    found = [_line(m) for m in DURATION.findall(text or "")]
    if FULL_DATE.search(text or ""):
        found = [t for t in found if not t.endswith("일")]
    return found[-1] if found else ""


def blocks(items: list[str], lines: list[dict]) -> list[tuple[str, str]]:
    """(label, content) of layout items, or else of label and content lines that follow each other."""
    out = []
    for item in items:
        label, content = re.search(r"label:\s*([^\n\r]+)", item, re.I), re.search(r"content:\s*(.*)", item, re.I | re.S)
        if label and content and _line(label[1]) and (body := _line(content[1].replace(SEPARATOR, " "))):
            out.append((_line(label[1]).lower(), body))
    label = ""
    for text in [] if out else [_line(x.get("text")) for x in lines]:
        name, _, rest = text.partition(":")
        if name.lower() == "label":
            label = _line(rest).lower()
        elif name.lower() == "content":
            out += [(label, _line(rest))] if label and _line(rest) else []
            label = ""
    return out


def without_marker(text: str) -> str:
    for p in (r"^\s*[①②③④⑤⑥⑦⑧⑨⑩]\s*", r"^\s*\d+[.)]\s*", r"^\s*[•·\-]\s*"):
        text = re.sub(p, "", text)
    return _line(text)


def key_of(text: str) -> str:
    """The name of a field: without marker and colon; empty for what is too short, too long or a rule."""
    key = _line(without_marker(text).strip(":-–— "))
    return key if len(_compact(key)) >= 2 and len(key) <= 40 and not re.fullmatch(r"[#*=\-_/\\\s]+", key) else ""


class Fields(dict):
    """Field -> values in order, each once."""

    def add(self, key: str, value: str) -> None:
        name, value = key_of(key), _line(value)
        if name and value and value not in self.setdefault(name, []):
            self[name].append(value)
        if name and not self.get(name, True):
            del self[name]


def row_fields(rows: list[list[str]], out: Fields) -> None:
    """Fields of a table's rows: first cell and the rest, or a lone name with the lone value after it."""
    waiting = None
    for row in rows:
        first = _line(row[0]) if row else ""
        if len(row) >= 2:
            waiting = None
            if all(len(_line(c)) <= 12 for c in row) and any(w in _line(" ".join(row)) for w in HEADER_WORDS):
                continue
            value = _line(" ".join(row[1:]))
            if _compact(key_of(first)) != _compact(value):
                out.add(first, value)
            if ITEM.match(first):
                out.add(ITEM_FIELD, without_marker(first))
            continue
        if not first:
            continue
        if FULL_DATE.search(first):
            out.add(DATE_FIELD, first)
        if first.endswith("귀하"):
            out.add(TO_FIELD, first)
        if ITEM.match(first):
            out.add(ITEM_FIELD, without_marker(first))
            waiting = None
        elif waiting and key_of(first) and _compact(waiting) != _compact(first):
            out.add(waiting, first)
            waiting = None
        else:
            waiting = key_of(first) if 0 < len(key_of(first)) <= 20 else None


def header_row(layout: list[list[dict]], width: int) -> int:
    """The row that most looks like names of columns; -1 if none does."""
    best, at = 0.0, -1
    for i, row in enumerate(layout[:5]):
        texts = [_line(c["text"]) for c in row if _line(c["text"])]
        if len(texts) < 2:
            continue
        points = 2.0 * sum(bool(HEADER_HINT.search(t)) for t in texts) + len(texts) / max(1, width) - 0.5 * sum(len(t) > 20 or bool(ITEM.match(t)) for t in texts)
        if points > best:
            best, at = points, i
    return at


def _best_cell(row: list[dict], start: int, end: int) -> str:
    """The cell that covers a column best, the first of equals."""
    scored = [(2 * o / (end - start + 1) + o / (c["end"] - c["start"] + 1), _line(c["text"])) for c in row if _line(c["text"]) and (o := min(end, c["end"]) - max(start, c["start"]) + 1) > 0]
    return max(scored, key=lambda x: x[0])[1] if scored else ""


def _named(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names, 1):
        n = _line(n) or f"col_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _pick(names: list[str], wanted: list[tuple[str, ...]]) -> str:
    return next((n for words in wanted for n in names if all(_compact(w) in _compact(n) for w in words)), "")


def table_records(html: str, table_index: int = 1) -> list[dict]:
    """The rows of a table under its column names: table_index, row_index, section (of a full-width row) or cells, and for period columns their raw text, label, value and source.

    A period comes from its cell, or from the opinion beside it, or is that of the last
    review item before.
    """
    layout, width = html_layout(html)
    if not layout or not width:
        return []
    at = header_row(layout, width)
    heads = [(c["start"], c["end"], c["text"]) for c in layout[at] if _line(c["text"])] if at >= 0 else []
    names = _named([h[2] for h in heads]) if heads else [f"col_{i + 1}" for i in range(width)]
    spans = [(h[0], h[1]) for h in heads] or [(i, i) for i in range(width)]
    first = at + 1 if heads else 0
    out, known = [], ""
    periods, opinions, items = [n for n in names if "기간" in n], [n for n in names if "의견" in n or "내용" in n], [n for n in names if "항목" in n or "구분" in n]
    for i, row in enumerate(layout[first:], first + 1):
        if not row:
            continue
        if len(row) == 1 and _line(row[0]["text"]) and row[0]["start"] == 0 and row[0]["end"] >= width - 1:
            out.append({"table_index": table_index, "row_index": i, "section": _line(row[0]["text"]), "cells": {}, "periods": {}})
            continue
        cells = {n: _best_cell(row, *s) for n, s in zip(names, spans)}
        if not any(cells.values()):
            continue
        review = any(REVIEW_ITEM.match(cells[n]) for n in items)
        told = {}
        for n in periods:
            raw = cells[n]
            own, beside = duration(raw), next((d for o in opinions if (d := duration(cells[o]))), "")
            carried = known if review and any(cells[x] for x in items) else ""
            value = own or beside or carried
            short = len(raw) <= 16 and raw.count(" ") <= 2
            source = ("direct_cell" if short else "inferred_token") if own else "inferred_token" if beside else "carried_forward" if carried else "empty"
            label = raw if raw and not own and len(raw) <= 20 and PERIOD_LABEL.search(raw) else ""
            told[n] = {"raw": raw, "label": label, "value": value, "source": source}
            cells[n] = value
            known = value if value and review else known
        out.append({"table_index": table_index, "row_index": i, "section": None, "cells": cells, "periods": told})
    return out


def sections(records: list[dict]) -> list[dict]:
    """Rows by the section rows above them: item, opinion and period of each; a period's label takes the value of a row after it that has nothing else.

    A value beside a label gives way only to one from a better source.
    """
    out: list[dict] = []
    for index in sorted({r["table_index"] for r in records}):
        rows = sorted((r for r in records if r["table_index"] == index), key=lambda r: r["row_index"])
        names = list(dict.fromkeys(n for r in rows for n in r["cells"]))
        if not names:
            continue
        item, opinion, period = (next((n for n in names if any(w in n for w in ws)), "") for ws in (("항목", "구분"), ("의견", "내용"), ("기간",)))

        def told(r: dict) -> dict:
            p = r["periods"].get(period, {"label": "", "value": "", "source": "empty"})
            return {"row_index": r["row_index"], "item": r["cells"].get(item, ""), "opinion": r["cells"].get(opinion, ""), "label": p["label"], "value": p["value"], "source": p["source"], "cells": r["cells"]}

        title, number, held, skip = "default", 1, [], False
        rows = [r for r in rows if r["section"] is not None or any(r["cells"].values())]
        for r, after in zip(rows, [*rows[1:], None]):
            if skip:
                skip = False
                continue
            if r["section"] is not None:
                if held:
                    out.append({"table_index": index, "section_index": number, "section_title": title, "rows": held})
                    held, number = [], number + 1
                title = r["section"] or f"section_{number}"
                continue
            row = told(r)
            nxt = told(after) if after is not None and after["section"] is None else None
            free = nxt and nxt["value"] and not nxt["item"] and not nxt["opinion"]
            if period and row["label"] and free and (not row["value"] or row["source"] != "direct_cell" and RANK[nxt["source"]] > RANK[row["source"]]):
                row["value"], row["source"], skip = nxt["value"], nxt["source"], True
            if row["item"] or row["opinion"] or row["label"] or row["value"]:
                held.append(row)
        if held:
            out.append({"table_index": index, "section_index": number, "section_title": title, "rows": held})
    return out


def review_fields(records: list[dict], out: Fields) -> None:
    """Items, opinions and periods of review tables as fields; only rows of marked items where a table has both items and opinions."""
    for r in records:
        names = list(r["cells"])
        item, opinion, period = _pick(names, ITEM_NAMES), _pick(names, OPINION_NAMES), _pick(names, PERIOD_NAMES)
        if item and opinion and not ITEM.match(r["cells"][item]):
            continue
        for field, name in ((ITEM_FIELD, item), (OPINION_FIELD, opinion), (PERIOD_FIELD, period)):
            if name and r["cells"][name]:
                out.add(field, without_marker(r["cells"][name]) if field == ITEM_FIELD else r["cells"][name])


def html_tables(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?is)<table\b.*?</table>", text or "")))


def structure(text: str, items: list[str], lines: list[dict]) -> dict[str, list[str]]:
    """The fields of a page: titles, tables, and name and value lines of other blocks."""
    out = Fields()
    found = blocks(items, lines)
    tables = [t for label, content in found if "table" in label for t in html_tables(content)] or html_tables(text)
    rest = [(label, _without_tags(content)) for label, content in found if "table" not in label]
    for label, content in rest:
        if "title" in label:
            out.add(TITLE_FIELD, content)
    for t in dict.fromkeys(tables):
        layout, _ = html_layout(t)
        row_fields([[_line(c["text"]) for c in row] for row in layout], out)
        review_fields([r for r in table_records(t) if r["section"] is None], out)
    for label, content in rest:
        if "title" not in label and (m := KEY_VALUE.match(content)):
            out.add(m[1], m[2])
    return dict(out)


def footnotes(items: list[str], lines: list[dict]) -> list[str]:
    """Footnote blocks, then other lines below tables, and recognised lines that no table cell holds, nearly the same."""
    found = blocks(items, [])
    cells = {_compact(c["text"]) for item in items for t in html_tables(item) for row in html_layout(t)[0] for c in row} - {""}
    notes = [_without_tags(c) for label, c in found if "footnote" in label] + [_without_tags(c) for label, c in found if label in ("text", "footer", "number")]

    def held(x: str) -> bool:
        near = (t for t in cells if min(len(x), len(t)) >= 8 and min(len(x), len(t)) >= 0.8 * max(len(x), len(t)))
        return x in cells or any(x in t or t in x or SequenceMatcher(None, x, t).ratio() >= 0.9 for t in near)

    for line in lines:
        text = _line(line.get("text"))
        low = text.lower()
        meta = low in META_LABELS or low.startswith(("label:", "bbox:", "content:")) or "<table" in low or "</table>" in low
        if line.get("score") is not None and not meta and _compact(text) and not held(_compact(text)):
            notes.append(text)
    return list(dict.fromkeys(n for n in notes if n))


# --- over tables of pages

_RECORD = "struct<table_index: int, row_index: int, section: string, cells: map<string, string>, periods: map<string, struct<raw: string, label: string, value: string, source: string>>>"
_ROW = "struct<row_index: int, item: string, opinion: string, label: string, value: string, source: string, cells: map<string, string>>"


def _over(pages: DataFrame, make, schema: str) -> DataFrame:
    kind = pages.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, items, lines in frame[["id", "text", "items", "lines"]].itertuples(index=False):
                items = [x for x in (items if items is not None else []) if x is not None]
                lines = [x if isinstance(x, dict) else x.asDict() for x in (lines if lines is not None else [])]
                lines = [{**x, "score": None if x.get("score") is None or x["score"] != x["score"] else x["score"]} for x in lines]
                out.append((key, *make(text or "", items, lines)))
            yield pd.DataFrame(out, columns=["id", *[s.split(" ", 1)[0] for s in _split(schema)]])

    return pages.select("id", "text", "items", "lines").mapInPandas(run, f"id {kind}, {schema}")


def _split(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


def predicted(pages: DataFrame) -> DataFrame:
    """(id, fields): the fields of each page.  pages: id, text, items (array<string>), lines (array<struct<text, score>>).  Nulls count as empty."""
    return _over(pages, lambda t, i, ls: (structure(t, i, ls),), "fields map<string, array<string>>")


def normalised_tables(pages: DataFrame) -> DataFrame:
    """(id, records, sections, footnotes): the tables of each page, row by row and by section, and its footnotes."""

    def make(text: str, items: list[str], lines: list[dict]) -> tuple:
        tables = list(dict.fromkeys(t for x in items for t in html_tables(x))) or html_tables(text)
        rows = [r for n, t in enumerate(tables, 1) for r in table_records(t, n)]
        return rows, sections(rows), footnotes(items, lines)

    return _over(pages, make, f"records array<{_RECORD}>, sections array<struct<table_index: int, section_index: int, section_title: string, rows: array<{_ROW}>>>, footnotes array<string>")


def preview(tables: DataFrame) -> DataFrame:
    """(id, html): the tables of each page as plain HTML, for a look at them."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = lambda r: F.array_join(F.transform(F.map_entries(r["cells"]), lambda e: F.concat(F.lit("<td title='"), esc(e["key"]), F.lit("'>"), esc(e["value"]), F.lit("</td>"))), "")
    row = lambda r: F.when(r["section"].isNotNull(), F.concat(F.lit("<tr><th>"), esc(r["section"]), F.lit("</th></tr>"))).otherwise(F.concat(F.lit("<tr>"), cells(r), F.lit("</tr>")))
    notes = F.array_join(F.transform("footnotes", lambda n: F.concat(F.lit("<p>"), esc(n), F.lit("</p>"))), "")
    return tables.select("id", F.concat(F.lit("<table>"), F.array_join(F.transform("records", row), ""), F.lit("</table>"), notes).alias("html"))
