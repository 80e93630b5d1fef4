"""Headings, sections, tables and runs of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.islands import scan

# Section types by the words of a heading path, in this order.
SECTIONS = [("overview", r"사업\s*개요|사업안내|목표|추진\s*배경"), ("requirements", r"과업|요구사항|제안\s*요청|수행\s*범위"), ("security", "보안|개인정보|접근권한|암호화"), ("evaluation", "평가|배점|협상"), ("bid_contract", "입찰|계약|공모|제출"), ("appendix_form", "붙임|서식|양식")]
# Markers of headings.
ROMAN, NUMBER, LETTER, CIRCLED = r"^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]{1,5})[.)]\s*(.+)$", r"^(\d{1,2})([.)])\s*(.+)$", r"^([가나다라마바사아자차카타파하])([.)])\s*(.+)$", r"^([①-⑳])\s*(.+)$"


def section_type(path: Column) -> Column:
    out = F.lit("body")
    for name, pattern in reversed(SECTIONS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def heading(line: Column) -> Column:
    """struct(level, title) of a heading line, null for any other."""
    s = T.inline(line)
    part = lambda p, i: F.regexp_extract(s, p, i)
    title = lambda p, i: T.strip(part(p, i))
    made = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("title"))
    number = F.when(part(NUMBER, 2) == ")", F.length(title(NUMBER, 3)) <= 55).otherwise(F.length(title(NUMBER, 3)) <= 90)
    return (
        F.when((s == "") | (F.length(s) > 120), None)
        .when(s.rlike(ROMAN) & (F.length(title(ROMAN, 2)) <= 70), made(1, F.concat(part(ROMAN, 1), F.lit(". "), title(ROMAN, 2))))
        .when(s.rlike(NUMBER), F.when(number, made(2, F.concat(part(NUMBER, 1), part(NUMBER, 2), F.lit(" "), title(NUMBER, 3)))))
        .when(s.rlike(LETTER) & ~((part(LETTER, 2) == ".") & title(LETTER, 3).rlike("[:：]")) & (F.length(title(LETTER, 3)) <= 70), made(3, F.concat(part(LETTER, 1), part(LETTER, 2), F.lit(" "), title(LETTER, 3))))
        .when(s.rlike(LETTER), None)
        .when(s.rlike(CIRCLED) & (F.length(title(CIRCLED, 2)) <= 70), made(4, F.concat(part(CIRCLED, 1), F.lit(" "), title(CIRCLED, 2))))
    )


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line): the non-blank lines of each text."""
    made = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    return made.where(F.length(T.strip(F.col("line"))) > 0)


def heading_path(marked: DataFrame, key: str) -> DataFrame:
    """Adds ``path``: the open headings at each record, outermost first.

    ``marked`` has (key, pos, level, title), level null where a record is no heading.  A level is
    open if no higher one came after it: running maxima of positions, no Python.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = marked
    for n in range(1, 5):
        own = F.when(F.col("level") == n, F.struct("pos", "title"))
        out = out.withColumn(f"h{n}", F.last(own, ignorenulls=True).over(w))
    parts, above = [], F.lit(-1)
    for n in range(1, 5):
        parts.append(F.when(F.col(f"h{n}.pos") > above, F.col(f"h{n}.title")))
        above = F.greatest(above, F.coalesce(F.col(f"h{n}.pos"), F.lit(-1)))
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop("h1", "h2", "h3", "h4")


def table_shape(n_rows: Column, n_cols: Column, first_col: Column, first_row: Column) -> Column:
    """Shape of a grid by its rows with content, its columns, and the filled cells of its first column and row."""
    return (
        F.when(n_rows == 0, "empty").when((n_rows == 1) | (n_cols == 1), "freeform")
        .when((n_cols <= 3) & (first_col >= F.greatest(F.lit(2), F.floor(n_rows * 0.6))), "vertical_key_value")
        .when((n_cols >= 5) & (n_rows >= 5), "matrix").when((n_rows <= 4) & (n_cols >= 4), "horizontal_matrix")
        .when(first_row >= F.greatest(F.lit(2), F.floor(n_cols * 0.5)), "header_rows").otherwise("mixed")
    )


def shapes(rows: DataFrame) -> DataFrame:
    """(file_name, table_id, n_rows, n_cols, shape) of tables given as rows of cells; a partially aggregated group-by."""
    filled = F.filter(F.map_values("cells"), lambda v: v.isNotNull() & (T.strip(v) != ""))
    n = F.coalesce(F.size(filled), F.lit(0))
    first = F.coalesce(T.strip(F.element_at(F.map_values("cells"), 1)), F.lit("")) != ""
    order = F.struct(F.coalesce("row_index", F.lit(-1)), "row_id")
    sums = rows.where(F.col("cells").isNotNull() & (F.size("cells") > 0)).groupBy("file_name", "table_id").agg(
        F.count_if(n > 0).alias("n_rows"), F.max(F.size("cells")).cast("bigint").alias("n_cols"), F.count_if((n > 0) & first).alias("f"), F.min_by(n, order).cast("bigint").alias("r"))
    return sums.select("file_name", "table_id", "n_rows", "n_cols", table_shape(F.col("n_rows"), F.col("n_cols"), F.col("f"), F.col("r")).alias("shape"))


def row_groups(rows: DataFrame, size: int = 10) -> DataFrame:
    """(file_name, table_id, grp, label, n, text): rows of each table in groups of ``size`` by order, with an a-b label."""
    w = Window.partitionBy("file_name", "table_id").orderBy(F.col("row_index").asc_nulls_first(), "row_id")
    placed = rows.select("file_name", "table_id", F.coalesce("_rag_row_text", F.lit("")).alias("t"), F.row_number().over(w).alias("rn"))
    grouped = placed.withColumn("grp", F.floor((F.col("rn") - 1) / size)).groupBy("file_name", "table_id", "grp")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]), "\n")
    return grouped.agg(F.concat_ws("-", F.min("rn").cast("string"), F.max("rn").cast("string")).alias("label"), F.count(F.lit(1)).alias("n"), text.alias("text"))


def runs(df: DataFrame, by: list[str], key: str, pos: str) -> DataFrame:
    """(key, island, n, first_pos, *by): consecutive records of equal ``by``, as islands."""
    seen = scan(df.withColumn("__k", F.to_json(F.struct(*by))), [key], [pos], lag=["__k"])
    flagged = seen.withColumn("__new", F.when(F.col("__k").eqNullSafe(F.col("prev___k")), 0).otherwise(1)).drop("__k", "prev___k")
    return scan(flagged, [key], [pos], total=["__new"]).groupBy(key, F.col("upto___new").alias("island"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"))
