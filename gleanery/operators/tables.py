"""Tables to chunks: rows as text, repeated rows, tables that go on, and packing.

Rows: file_name, table_id, row_order (unique in a table), row_index, cells (map), text.
Tables: file_name, table_id, pos, section_path, table_type, n_rows, n_cols, shape, header.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.islands import scan
from gleanery.functions.numbering import positions
from gleanery.operators.splitters import _clean, oversized

SIZE, MOST_ROWS, SPLIT_OVERLAP, GAP = 1200, 30, 80, 40
# Table types that may continue each other, and labels of kinds of chunks.
OPEN_TYPES = ["data_table", "schedule_table", "requirement_table", "evaluation_table"]
KIND_LABELS = {"section_text": "본문", "cover_text": "표지"}
TABLE_LABEL = "표"


def cell_lines(cells: Column) -> Column:
    """The cells of a row as ``name: value`` lines; unnamed columns (col_...) as values alone, those whose value stood before left out."""
    pairs = F.transform(F.map_entries(cells), lambda e: F.struct(T.inline(e["key"]).alias("k"), T.inline(e["value"]).alias("v")))
    told = F.filter(pairs, lambda p: (p["v"] != "") & (p["v"] != p["k"]))
    keys = F.transform(told, lambda p: T.compact(p["v"]))
    unnamed = lambda p: F.startswith(p["k"], F.lit("col_"))
    kept = F.filter(told, lambda p, i: ~(unnamed(p) & F.array_contains(F.slice(keys, F.lit(1), i), T.compact(p["v"]))))
    return F.transform(kept, lambda p: F.when(unnamed(p), p["v"]).otherwise(F.concat(p["k"], F.lit(": "), p["v"])))


def row_text(cells: Column, text: Column) -> Column:
    """The lines of a row's cells, or its cleaned text where they give none."""
    lines = F.coalesce(cell_lines(cells), F.array().cast("array<string>"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(T.clean_block(F.coalesce(text, F.lit(""))))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(file_name, table_id, row_order, row_index, body): the rows of each table with content, equal ones once, the first by order.

    Equal is what is equal without white space and case.  Each table's key meets in a
    partially aggregated group-by; no window spans a table.
    """
    told = rows.withColumn("body", row_text(F.col("cells"), F.col("text"))).withColumn("__k", T.compact(F.col("body"))).where("__k <> ''")
    first = told.groupBy("file_name", "table_id", F.md5("__k").alias("__h")).agg(F.min_by(F.struct("row_order", "row_index", "body"), "row_order").alias("x"))
    return first.select("file_name", "table_id", "x.*")


def header_words(cells: Column, n: Column) -> Column:
    """Named columns of a table's first rows, compacted; ``n`` says which row of its table this is."""
    keys = F.filter(F.transform(F.map_keys(cells), lambda k: T.compact(T.inline(k))), lambda k: (k != "") & ~F.startswith(k, F.lit("col")))
    return F.when(n <= 5, keys)


def continued(tables: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Adds group, role (start, continued), came_from and goes_to to tables that go on across pages.

    A table goes on with the one before in its file if section path and column count are
    equal, types are equal or both open, headers overlap by half of the smaller one (if both
    have some), and nothing but blank or short text lies between.  ``gaps``: file_name, pos,
    content_type, text of the other records.  Groups are numbered over all files by where
    they start.  Files of any size: neighbours meet across range partitions.
    """
    kinds = [F.lit(True).alias("__table"), F.lit(0).alias("__block")]
    rows = tables.select("*", *kinds)
    if gaps is not None:
        short = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")) <= GAP
        other = gaps.select("file_name", "pos", F.lit(False).alias("__table"), (~(F.col("content_type").isin("section_text", "cover_text", "toc") & short)).cast("int").alias("__block")).where("__block = 1")
        rows = rows.unionByName(other, allowMissingColumns=True)
        rows = scan(rows, ["file_name"], ["pos"], total=["__block"]).where("__table").withColumn("__b", F.col("upto___block")).drop("upto___block")
    else:
        rows = rows.withColumn("__b", F.lit(0))
    me = F.struct("section_path", "n_cols", "table_type", "header", "__b", "table_id")
    seen = scan(rows.withColumn("__me", me), ["file_name"], ["pos"], lag=["__me"]).drop("__me")
    p = lambda c: F.col(f"prev___me.{c}")
    n, m = F.size(F.coalesce("header", F.array().cast("array<string>"))), F.size(F.coalesce(p("header"), F.array().cast("array<string>")))
    alike = F.when((n > 0) & (m > 0), F.size(F.array_intersect("header", p("header"))) >= 0.5 * F.least(n, m)).otherwise(True)
    types = p("table_type").eqNullSafe(F.col("table_type")) | (F.col("table_type").isin(OPEN_TYPES) & p("table_type").isin(OPEN_TYPES))
    on = F.col("prev___me").isNotNull() & p("section_path").eqNullSafe(F.col("section_path")) & (p("n_cols") == F.col("n_cols")) & (F.col("n_cols") > 0) & types & (p("__b") == F.col("__b")) & alike
    flagged = seen.withColumns({"__on": F.coalesce(on, F.lit(False)), "__from": p("table_id")}).withColumn("__new", (~F.col("__on")).cast("int")).drop("prev___me", "__b", "__table", "__block")
    chained = scan(flagged, ["file_name"], ["pos"], total=["__new"])
    sizes = chained.groupBy("file_name", "upto___new").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n > 1")
    named = positions(sizes, [], ["file_name", "first"], "no").select(F.col("file_name").alias("__f"), F.col("upto___new").alias("__c"), F.format_string("table_continuation_%04d", "no").alias("group"))
    out = chained.join(named, F.col("file_name").eqNullSafe(F.col("__f")) & (F.col("upto___new") == F.col("__c")), "left")
    out = out.withColumns({"role": F.when(F.col("group").isNotNull(), F.when(F.col("__on"), "continued").otherwise("start")), "came_from": F.when(F.col("__on"), F.col("__from"))})
    back = out.where("__on").select(F.col("file_name").alias("__f2"), F.col("__from").alias("__t2"), (F.col("upto___new")).alias("__c2"), F.col("table_id").alias("goes_to"))
    same = F.col("file_name").eqNullSafe(F.col("__f2")) & (F.col("table_id") == F.col("__t2")) & (F.col("upto___new") == F.col("__c2"))
    return out.join(back, same, "left").drop("__f", "__c", "__f2", "__t2", "__c2", "__on", "__from", "__new", "upto___new")


def continuation_line(group: Column, role: Column, table_id: Column, came_from: Column, goes_to: Column) -> Column:
    """What a chunk of a table that goes on says about it; null for others."""
    further = F.coalesce(F.concat(F.lit(" Continued to table "), F.nullif(goes_to, F.lit("")), F.lit(".")), F.lit(""))
    head = F.concat(F.lit("[TABLE CONTINUATION "), group, F.lit("] Table "), F.coalesce(table_id, F.lit("")))
    start = F.concat(head, F.lit(" starts a table split across pages."), further)
    return F.when(role == "start", start).when(role == "continued", F.concat(head, F.lit(" continues from table "), F.coalesce(came_from, F.lit("")), F.lit("."), further))


def next_table(table_id: Column, table_type: Column, shape: Column, n_rows: Column, n_cols: Column) -> Column:
    """The mark of a table that follows a text; null without an id."""
    part = lambda name, c: F.coalesce(F.concat(F.lit(name), F.nullif(c.cast("string"), F.lit(""))), F.lit(""))
    size = F.when((n_rows > 0) & (n_cols > 0), F.concat(F.lit(", "), n_rows.cast("string"), F.lit("행x"), n_cols.cast("string"), F.lit("열"))).otherwise("")
    return F.when(F.coalesce(table_id, F.lit("")) != "", F.concat(F.lit("[다음 표: "), table_id, part(", 유형=", table_type), part(", 형태=", shape), size, F.lit("]")))


def context_lines(file_name: Column, section: Column, heading: Column, chunk_type: Column, extra: list[Column] | None = None) -> Column:
    """The lines before a chunk's body: document, section, heading, kind, and more."""
    label = F.when(chunk_type.startswith("table_"), TABLE_LABEL)
    for k, v in KIND_LABELS.items():
        label = label.when(chunk_type == k, v)
    section, heading = F.nullif(section, F.lit("")), F.nullif(heading, F.lit(""))
    title = F.when(~heading.eqNullSafe(section), F.concat(F.lit("제목: "), heading))
    more = [F.when(F.length(T.inline(x)) > 0, x) for x in extra or []]
    return F.concat_ws("\n", F.concat(F.lit("문서명: "), F.coalesce(file_name, F.lit(""))), F.concat(F.lit("섹션경로: "), section), title, F.concat(F.lit("자료유형: "), label.otherwise(chunk_type)), *more)


def pack(rows: DataFrame, size: int = SIZE, most: int = MOST_ROWS) -> DataFrame:
    """(file_name, table_id, no, body, row_range, row_indices): the rows of each table in order, packed up to ``size`` characters and ``most`` rows.

    Each row begins with its number; a row over the size is cut on its own.  Rows of a table
    are sorted within a partition and read as a stream: only the open chunk is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, held, length, no = None, [], 0, 0
        for frame in frames:
            out = []

            def emit(parts: list[tuple[str, int | None]], body: str | None = None) -> None:
                nonlocal no
                no += 1
                seen = [i for _, i in parts if i is not None]
                label = "" if not seen else str(seen[0]) if len(seen) == 1 else f"{seen[0]}-{seen[-1]}"
                out.append((*table, no, "\n\n".join(p for p, _ in parts) if body is None else body, label, seen))

            def flush() -> None:
                nonlocal held, length
                if held:
                    emit(held)
                held, length = [], 0

            for name, tid, index, body in zip(frame["file_name"], frame["table_id"], frame["row_index"], frame["body"], strict=True):
                if (name, tid) != table:
                    flush()
                    table, no = (name, tid), 0
                index = None if pd.isna(index) else int(index)
                part = _clean((f"행 {index}\n" if index is not None else "") + body)
                if not part:
                    continue
                if held and (length + 2 + len(part) > size or len(held) >= most):
                    flush()
                if len(part) > size:
                    flush()
                    for piece in oversized(part, size, SPLIT_OVERLAP):
                        emit([(piece, index)], piece)
                    continue
                held.append((part, index))
                length += 2 + len(part)
            yield pd.DataFrame(out, columns=["file_name", "table_id", "no", "body", "row_range", "row_indices"])
        if held:
            out = []
            no += 1
            seen = [i for _, i in held if i is not None]
            label = "" if not seen else str(seen[0]) if len(seen) == 1 else f"{seen[0]}-{seen[-1]}"
            yield pd.DataFrame([(*table, no, "\n\n".join(p for p, _ in held), label, seen)], columns=["file_name", "table_id", "no", "body", "row_range", "row_indices"])

    sorted_ = rows.select("file_name", "table_id", F.col("row_index").cast("bigint").alias("row_index"), "body", "row_order").repartition("file_name", "table_id").sortWithinPartitions("file_name", "table_id", "row_order")
    return sorted_.mapInPandas(run, "file_name string, table_id string, no int, body string, row_range string, row_indices array<bigint>")


def _pieces(size: int):
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: oversized(t, size, SPLIT_OVERLAP) if t else [])

    return cut


def summary_groups(size: int = SIZE):
    """A UDF: summary lines packed up to ``size`` characters into struct(no, part, body); a line over it is cut on its own."""

    @F.pandas_udf("array<struct<no: int, part: int, body: string>>")
    def groups(lines: pd.Series) -> pd.Series:
        done = []
        for own in lines:
            out, held, no = [], [], 1

            def flush():
                nonlocal held, no
                if held:
                    out.append({"no": no, "part": None, "body": "\n".join(held)})
                    no += 1
                held = []

            for line in map(_clean, [x or "" for x in own] if own is not None else []):
                if not line:
                    continue
                if held and sum(len(x) + 1 for x in held) + 1 + len(line) > size:
                    flush()
                if len(line) > size:
                    flush()
                    out += [{"no": no, "part": k, "body": p} for k, p in enumerate(oversized(line, size, SPLIT_OVERLAP), 1)]
                    no += 1
                else:
                    held.append(line)
            flush()
            done.append(out)
        return pd.Series(done)

    return groups


def chunks(tables: DataFrame, rows: DataFrame, size: int = SIZE, most: int = MOST_ROWS) -> DataFrame:
    """(chunk_id, file_name, table_id, chunk_type, row_range, part, text, metadata): every table by the first of its rows, row groups, summary lines and markdown that it has.

    tables: as above, with optional heading, section_type, context (a short text before it),
    row_groups (array<struct<row_range, text>>), summary_lines (array), markdown, and the
    columns of :func:`continued`.  Tables of the same file and id are one.
    """
    kinds = {"heading": "string", "section_type": "string", "context": "string", "markdown": "string", "summary_lines": "array<string>", "row_groups": "array<struct<row_range: string, text: string>>", "group": "string", "role": "string", "came_from": "string", "goes_to": "string", "shape": "string"}
    t = tables.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in tables.columns})
    kept = distinct_rows(rows)
    deduped = kept.groupBy("file_name", "table_id").agg(F.count(F.lit(1)).alias("deduped"))
    key = ["file_name", "table_id"]

    def meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({"file_name": "__f", "table_id": "__t"})
        return a.join(b, F.col("file_name").eqNullSafe(F.col("__f")) & F.col("table_id").eqNullSafe(F.col("__t")), how).drop("__f", "__t")

    r = meet(pack(kept, size, most), deduped)
    none = lambda k: F.lit(None).cast(k)
    by_rows = r.select(*key, F.lit("table_rows").alias("kind"), "no", none("int").alias("part"), "row_range", "body", "deduped")
    rest = meet(t, deduped, "left_anti")
    cut, groups = _pieces(size), summary_groups(size)
    many = lambda c: F.size(F.coalesce(F.col(c), F.array().cast(kinds[c]))) > 0
    of_groups = rest.where(many("row_groups")).select(*key, F.posexplode("row_groups").alias("no", "g")).select(*key, "no", F.col("g.row_range").alias("row_range"), F.posexplode(cut(T.clean_block(F.coalesce("g.text", F.lit(""))))).alias("i", "body"))
    by_groups = of_groups.select(*key, F.lit("table_group").alias("kind"), (F.col("no") * 10_000 + F.col("i")).alias("no"), F.when(F.col("i") > 0, F.col("i") + 1).alias("part"), "row_range", "body", none("bigint").alias("deduped"))
    of_lines = rest.where(~many("row_groups") & many("summary_lines")).select(*key, F.posexplode(groups("summary_lines")).alias("no", "s"))
    by_lines = of_lines.select(*key, F.lit("table_summary").alias("kind"), "no", F.col("s.part").alias("part"), none("string").alias("row_range"), F.col("s.body").alias("body"), none("bigint").alias("deduped"))
    of_text = rest.where(~many("row_groups") & ~many("summary_lines") & (F.length(T.strip(F.coalesce("markdown", F.lit("")))) > 0)).select(*key, F.posexplode(cut(T.clean_block(F.col("markdown")))).alias("no", "body"))
    by_text = of_text.select(*key, F.lit("table_markdown").alias("kind"), "no", F.when(F.col("no") > 0, F.col("no") + 1).alias("part"), none("string").alias("row_range"), "body", none("bigint").alias("deduped"))
    pieces = by_rows.unionByName(by_groups).unionByName(by_lines).unionByName(by_text)
    facts = t.groupBy(*key).agg(*[F.min_by(c, "pos").alias(c) for c in ("section_path", "section_type", "heading", "table_type", "shape", "n_rows", "n_cols", "context", "group", "role", "came_from", "goes_to")], F.min("pos").alias("pos"))
    whole = meet(pieces, facts)
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    kind = F.concat_ws("/", "kind", F.coalesce(F.nullif("table_type", F.lit("")), F.lit("table")))
    note = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("직전본문: "), F.col("context")))
    after = F.when(note.isNotNull(), F.lit("The following table appears after the previous context."))
    head = context_lines(F.col("file_name"), path, F.col("heading"), kind, [note, after, continuation_line(F.col("group"), F.col("role"), F.col("table_id"), F.col("came_from"), F.col("goes_to"))])
    text = T.clean_block(F.concat(head, F.lit("\n\n"), T.clean_block(F.col("body"))))
    told = {"file_name": "file_name", "section_type": "section_type", "heading": "heading", "table_id": "table_id", "table_type": "table_type", "table_shape": "shape", "table_rows": "n_rows", "table_cols": "n_cols", "continuation_group_id": "group", "table_continuation_role": "role", "continued_from_table_id": "came_from", "continued_to_table_id": "goes_to", "row_range": "row_range", "split_part": "part", "deduped_table_rows": "deduped"}
    pairs = [F.lit("section_path_text"), path, F.lit("body_chars"), F.length("body").cast("string")]
    for k, c in told.items():
        pairs += [F.lit(k), F.col(c).cast("string")]
    made = whole.select("file_name", "table_id", "pos", "no", kind.alias("chunk_type"), "row_range", "part", text.alias("text"), F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull() & (v != "")).alias("metadata"))
    placed = positions(made, [], ["file_name", "pos", "table_id", "no"], "n")
    return placed.select(F.concat(F.format_string("chunk_%08d_", "n"), T.short_hash(F.col("text"))).alias("chunk_id"), "file_name", "table_id", "chunk_type", "row_range", "part", "text", "metadata")
