"""Words on pages to rows, cells and tables; tables in HTML to grids."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TOLERANCE, GAP, TIMES = 3.5, 18.0, 2.8


def outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in no box of their page: an anti-join on page and ranges."""
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    inside = (F.col("w.doc") == F.col("b.doc")) & (F.col("w.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    return words.alias("w").join(boxes.alias("b"), inside, "left_anti")


def word_rows(words: DataFrame) -> DataFrame:
    """Adds ``row`` to words (doc, page, x0, x1, y0, y1, text): one row while y stays within TOLERANCE of the row's mean.

    One page is put together at a time; a page's words are bounded by the page.
    """

    def rows(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        out, mean, n, row = [], None, 0, -1
        for y in page["y0"]:
            if mean is None or abs(y - mean) > TOLERANCE:
                row, mean, n = row + 1, y, 1
            else:
                mean, n = (mean * n + y) / (n + 1), n + 1
            out.append(row)
        return page.assign(row=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", row int"
    return words.groupBy("doc", "page").applyInPandas(rows, schema)


def row_cells(rows: DataFrame) -> DataFrame:
    """(doc, page, row, cell, x0, x1, text): words of a row, apart where the gap is wide for the row."""
    line = Window.partitionBy("doc", "page", "row").orderBy("x0", "x1")
    gaps = rows.withColumn("gap", F.col("x0") - F.lag("x1").over(line))
    middle = gaps.groupBy("doc", "page", "row").agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"))
    wide = F.col("gap") >= F.greatest(F.lit(GAP), TIMES * F.coalesce("m", F.lit(0.0)))
    placed = gaps.join(middle, ["doc", "page", "row"]).withColumn("cell", F.sum(F.coalesce(wide.cast("int"), F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy("doc", "page", "row", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))


def table_rows(cells: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``table``: rows of at least two cells in a row, at least ``least`` of them; other rows are left out."""
    rows = cells.groupBy("doc", "page", "row").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy("doc", "page").orderBy("row")
    islands = rows.withColumn("table", F.col("row") - F.row_number().over(w)).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc", "page", "table"))).where(F.col("k") >= least)
    return cells.join(islands.select("doc", "page", "row", "table"), ["doc", "page", "row"])


def headers_of(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Each body cell with the header cell whose columns it overlaps best; the first one wins a tie.

    cells, headers: (table_id, pos, first, last, text); ranges of columns are inclusive.
    """
    over = F.least("c.last", "h.last") - F.greatest("c.first", "h.first") + 1
    meets = (F.col("c.table_id") == F.col("h.table_id")) & (F.col("c.first") <= F.col("h.last")) & (F.col("h.first") <= F.col("c.last"))
    score = 2 * over / (F.col("c.last") - F.col("c.first") + 1) + over / (F.col("h.last") - F.col("h.first") + 1)
    both = cells.alias("c").join(headers.alias("h"), meets).select("c.table_id", F.col("c.pos").alias("pos"), F.col("c.text").alias("text"), F.col("h.text").alias("header"), F.col("h.pos").alias("h_pos"), score.alias("score"))
    return both.groupBy("table_id", "pos", "text").agg(F.max_by("header", F.struct("score", -F.col("h_pos"))).alias("header"))


class _Grid(HTMLParser):
    """Collects the cells of an HTML table with their spans."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: dict[tuple[int, int], str] = {}
        self.rows: dict[int, list[dict]] = {}
        self.row, self.open, self.text = -1, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            self._close()
            a = dict(attrs)
            number = lambda k: max(1, min(200, int(a.get(k)))) if str(a.get(k) or "").isdigit() else 1
            self.row = max(self.row, 0)
            self.open, self.text = (number("rowspan"), number("colspan")), []
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.open:
            self.text.append(data)

    def _close(self):
        if self.open:
            col = 0
            while (self.row, col) in self.cells:
                col += 1
            value = " ".join("".join(self.text).split())
            self.rows.setdefault(self.row, []).append({"start": col, "end": col + self.open[1] - 1, "text": value})
            for r in range(self.open[0]):
                for c in range(self.open[1]):
                    self.cells.setdefault((self.row + r, col + c), value)
            self.open = None


def html_grid(html: str | None) -> list[list[str]]:
    """The grid of an HTML table, spanned cells repeated, missing ones empty."""
    p = _Grid()
    p.feed(html or "")
    p._close()
    if not p.cells:
        return []
    rows, cols = max(r for r, _ in p.cells) + 1, max(c for _, c in p.cells) + 1
    return [[p.cells.get((r, c), "") for c in range(cols)] for r in range(rows)]


def html_layout(html: str | None) -> tuple[list[list[dict]], int]:
    """The own cells of each row with the columns that they span (start, end, text), and the number of columns."""
    p = _Grid()
    p.feed(html or "")
    p._close()
    return [p.rows.get(r, []) for r in range(max(p.rows, default=-1) + 1)], max((c for _, c in p.cells), default=-1) + 1


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def grid(html: pd.Series) -> pd.Series:
    """:func:`html_grid` for a column."""
    return html.map(html_grid)


def grid_records(grids: DataFrame, key: str = "id", column: str = "grid") -> DataFrame:
    """(key, row, name, value): cells under the names of the first row, without repeats of a spanned value in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, g in zip(frame[key], frame[column], strict=True):
                g = [list(r) for r in g] if g is not None else []
                for n, row in enumerate(g[1:], 1):
                    seen = set()
                    for i, value in enumerate(row):
                        name = g[0][i] or f"col_{i + 1}"
                        if value and (name, value) not in seen:
                            seen.add((name, value))
                            out.append((k, n, name, value))
            yield pd.DataFrame(out, columns=[key, "row", "name", "value"])

    return grids.select(key, column).mapInPandas(run, f"`{key}` {grids.schema[key].dataType.simpleString()}, row int, name string, value string")


def carried_forward(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Adds ``<value>_filled``: the last value known so far in each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(w))
