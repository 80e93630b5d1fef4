"""Jobs over directories: parsed files to slim chunks, raw tables, errors and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.numbering import positions
from gleanery.operators import records as R
from gleanery.operators.splitters import pruned
from gleanery.sources import files

# Metadata that chunks keep for filters and citations, and that slim chunks keep.
COMMON_KEYS = ["file_name", "section_path", "section_type", "heading"]
TABLE_KEYS = ["table_type", "table_shape", "table_id", "row_range", "continuation_group_id", "table_continuation_role", "continued_from_table_id", "continued_to_table_id"]
LINK_KEYS = ["next_table_id", "next_table_type", "next_table_shape"]
SLIM_KEYS = ["file_name", "section_path_text", "section_type", "heading", "chunk_type", "table_type", "table_shape", "table_id", "row_range", *LINK_KEYS, "row_indices", "summary_group_index", "part_index", "source_content_type"]
# What a sign-off row of a table says.
SIGNATURE = r"^(?:작성자|검토자|확인자|승인자|담당자|서명|성명|소속|직위|날인|인|\(인\)|작성일|일자)\s*[:：]?.{0,20}$"


def compact_metadata(chunk_type: Column, metadata: Column) -> Column:
    """The common keys, and those of tables or of the next table by the kind of the chunk, without empty values."""
    is_table = F.startswith(F.coalesce(chunk_type, F.lit("")), F.lit("table_"))
    return F.map_filter(pruned(F.coalesce(metadata, F.create_map().cast("map<string,string>"))), lambda k, _v: k.isin(COMMON_KEYS) | (is_table & k.isin(TABLE_KEYS)) | (~is_table & k.isin(LINK_KEYS)))


def slim(chunks: DataFrame, order: list[str]) -> DataFrame:
    """(chunk_id, source_id, chunk_type, text, metadata): chunks renumbered in ``order`` with the slim keys and their number."""
    placed = positions(chunks, [], order, "__n")
    kept = F.map_filter(pruned(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda k, _v: k.isin(SLIM_KEYS))
    meta = F.map_concat(kept, F.create_map(F.lit("global_index"), F.col("__n").cast("string")))
    return placed.select(F.format_string("slim_chunk_%08d", "__n").alias("chunk_id"), F.col("chunk_id").alias("source_id"), F.coalesce("chunk_type", F.lit("")).alias("chunk_type"), F.coalesce("text", F.lit("")).alias("text"), meta.alias("metadata"))


def embedding_input(rows: DataFrame, order: list[str], doc_id: str | None = None) -> DataFrame:
    """(id, doc_id, text, metadata): chunks, parsed records and tables in one form; rows without text are left out.

    rows may have chunk_id, section_id, table_id, id, doc_id, file_name, chunk_text, text,
    table_lines (array), metadata (map), content_type, section_path (array), section_type
    and table_type.
    """
    have = lambda c, kind="string": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    filled = lambda c: F.nullif(T.strip(c), F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(have(c), F.lit("")) for c in cs])
    lines = F.array_join(F.filter(F.transform(F.coalesce(have("table_lines", "array<string>"), F.array().cast("array<string>")), T.strip), lambda x: x != ""), "\n")
    placed = positions(rows, [], order, "__n", 0)
    text = F.coalesce(filled(have("chunk_text")), filled(have("text")), F.nullif(lines, F.lit("")))
    own = F.coalesce(have("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    more = F.create_map(
        F.lit("content_type"), F.coalesce(have("content_type"), F.lit("")), F.lit("heading_path"), F.to_json(F.coalesce(have("section_path", "array<string>"), F.array().cast("array<string>"))),
        F.lit("section_type"), F.coalesce(have("section_type"), F.lit("")), F.lit("table_type"), F.coalesce(have("table_type"), F.lit("")),
    )
    meta = F.map_concat(F.map_filter(more, lambda k, _v: ~F.array_contains(F.map_keys(own), k)), own)
    name = F.lit(doc_id) if doc_id else F.coalesce(first("doc_id", "file_name"), F.lit("unknown_doc"))
    made = placed.select(F.coalesce(first("chunk_id", "section_id", "table_id", "id"), F.format_string("row_%05d", "__n")).alias("id"), name.alias("doc_id"), text.alias("text"), meta.alias("metadata"))
    return made.where("text IS NOT NULL")


def is_signature(item: Column, opinion: Column, period: Column) -> Column:
    """Whether a table row only holds who signed it."""
    a, b = T.inline(item), T.inline(opinion)
    ok = lambda c: (c == "") | c.rlike(SIGNATURE)
    return (F.coalesce(period, F.lit("")) == "") & ((a != "") | (b != "")) & ok(a) & ok(b)


def safe_stem(name: Column) -> Column:
    """A name for an output file."""
    stem = F.regexp_replace(name, r'(?U)[\\/:*?"<>|&\s]+', "_")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "^[._]+", ""), "[._]+$", ""), "_+", "_")
    return F.when(F.coalesce(stem, F.lit("")) == "", "chunks").otherwise(stem)


def first_files(found: DataFrame, n: int, key: str = "file_name", pos: str = "pos") -> DataFrame:
    """The rows of the first ``n`` files by where they first appear; all rows for 0."""
    if n <= 0:
        return found
    chosen = found.groupBy(key).agg(F.min(pos).alias("__p")).orderBy("__p", key).limit(n).select(key)
    return found.join(F.broadcast(chosen), key, "left_semi")  # n rows


def first_appearance(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, n, first, place): the size of each group and its place by first appearance."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return positions(sizes, [], ["first", key], "place")


def counters(found: DataFrame, errors: DataFrame, records: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: target and error files, records, chunks, table chunks, text chunks, raw table rows."""
    one = lambda df, name, cond=None: df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name))
    is_table = F.startswith(F.coalesce("chunk_type", F.lit("")), F.lit("table_"))
    parts = [one(found, "target_files"), one(errors, "error_files"), one(records, "prechunk_records"), chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(is_table).alias("table_chunks")), one(tables, "table_raw_rows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("text_chunks", F.col("chunks") - F.col("table_chunks"))


def merge_counters(merged: DataFrame) -> DataFrame:
    """One row: sources, rows and collisions of merged tables (source, chunk_id, merged_id)."""
    return merged.agg(F.countDistinct("source").alias("files"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("chunk_id") != F.col("merged_id")).alias("collisions"))


def run(parsed: DataFrame, machine: Callable[[DataFrame], DataFrame], limit_files: int = 0) -> dict[str, DataFrame]:
    """Events of files to records, slim chunks, raw tables and counters.

    parsed: file_name, pos, error, and what the machine reads; a file with an error gives an
    error row and no records, and stops nothing.  ``machine`` is one of
    ``parsing.pdf_records`` and ``parsing.hwp_records``.
    """
    chosen = first_files(parsed, limit_files)
    errors = chosen.where("error IS NOT NULL").groupBy("file_name").agg(F.first("error").alias("error"))
    records = machine(chosen.join(errors.select("file_name"), "file_name", "left_anti").drop("error"))
    lines = F.coalesce(F.col("table.rows_data.text"), F.col("table.row_groups.text"), F.col("table.summary_lines"), F.col("table.items"))
    flat = records.select(
        "file_name", "pos", "content_type", "section_path", F.coalesce("text", F.array_join(lines, "\n")).alias("text"), "table_id", "table_type", F.col("table.shape").alias("shape"), F.col("table.cols").alias("n_cols"),
        F.coalesce(F.map_keys(F.try_element_at(F.col("table.rows_data"), F.lit(1))["cells"]), F.array().cast("array<string>")).alias("header"), lines.alias("rows"),
    )
    made = R.chunks(flat)
    tables = files.raw_tables(flat)
    with_meta = made.withColumn("metadata", F.create_map(F.lit("file_name"), F.col("file_name"), F.lit("section_path_text"), F.col("section_path_text"), F.lit("table_id"), F.col("table_id"), F.lit("part_index"), F.col("part").cast("string"), F.lit("chunk_type"), F.col("chunk_type")))
    found = chosen.select("file_name").distinct()
    return {"records": records, "chunks": slim(with_meta, ["chunk_id"]), "tables": tables, "errors": errors, "counters": counters(found, errors, records, made, tables)}
