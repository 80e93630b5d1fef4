"""Readers and writers: JSON lines, concatenated JSON, CSV, files of any kind, index tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.functions import text as T
from gleanery.functions.numbering import positions

# Names that the column of file names may have in metadata tables, in this order.
FILE_COLUMNS = ["file_path", "filepath", "path", "file_name", "filename", "파일명", "문서명"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped, a missing path gives no rows.

    ``strict`` fails on a malformed line and names it with the offset of its block in the
    file, else its fields are null.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if not strict:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
    marked = StructType(kind.fields).add("__bad", "string")
    row = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    told = F.concat(F.lit("malformed line in "), F.col("f"), F.lit(" after byte "), F.col("at").cast("string"), F.lit(": "), F.left("value", F.lit(200)))
    checked = lines.withColumn("r", row).withColumn("r", F.when(F.col("r").isNull() | F.col("r.__bad").isNotNull(), F.raise_error(told).cast(marked)).otherwise(F.col("r")))
    return checked.select("r.*").drop("__bad")


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None, limit: int | None = None) -> None:
    """JSON lines, null fields kept; ``order`` sorts across files, ``limit`` keeps the first rows of that order."""
    if limit is not None:
        df = df.orderBy(*(order or [])).limit(limit) if order else df.limit(limit)
    elif order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _decoded(text: str) -> Iterator[object]:
    decoder, at, n = json.JSONDecoder(), 0, len(text)
    while True:
        while at < n and text[at] in " \t\r\n,﻿":
            at += 1
        if at >= n:
            return
        value, at = decoder.raw_decode(text, at)
        yield from value if isinstance(value, list) else [value]


def read_any_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, record): JSON arrays, JSON lines and objects one after the other, each record as JSON text.

    A file that breaks off gives the records before the break and one with a null record.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                pos = 0
                try:
                    for value in _decoded(bytes(content).decode("utf-8", "replace")):
                        out.append((name, pos, json.dumps(value, ensure_ascii=False)))
                        pos += 1
                except ValueError:
                    out.append((name, pos, None))
            yield pd.DataFrame(out, columns=["path", "pos", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos int, record string")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; reading the result fails where there is none."""
    hit = df.where(F.col(key) == F.lit(value)).limit(1).agg(F.first(F.struct(*df.columns)).alias("r"))
    found = F.when(F.col("r").isNull(), F.raise_error(F.lit(f"no row with {key} = {value}")).cast(hit.schema["r"].dataType)).otherwise(F.col("r"))
    return hit.select(found.alias("r")).select("r.*")


def lenient_object(c: Column) -> Column:
    """A JSON object as map<string,string>; an empty map for anything else."""
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns as text; a missing path gives no rows of one column."""
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path) if _exists(spark, path) else spark.createDataFrame([], "file_name string")


def file_column(df: DataFrame) -> str | None:
    """The first column that names files."""
    return next((c for c in FILE_COLUMNS if c in df.columns), None)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV files with headers; ``columns`` chooses and orders them, missing ones are empty."""
    df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else df
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, most: int = 1_000_000) -> None:
    """One CSV file with a byte-order mark, as spreadsheets expect: for reports of at most ``most`` rows, more fail."""
    import csv

    names = columns or df.columns
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]).limit(most + 1)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(names)
        for n, row in enumerate(rows.toLocalIterator()):
            if n == most:
                raise ValueError(f"more than {most} rows; use write_csv")
            writer.writerow(["" if v is None else "|".join(map(str, v)) if isinstance(v, list) else v for v in row])


def discover(spark: SparkSession, folder: str, suffixes: list[str] | None = None, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, name, stem, suffix, length, pos) of the files of a folder, without their contents; ``pattern`` is a glob of names.

    ``pos`` counts them by path without regard to case.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), "length")
    out = out.where(F.col("suffix").isin([s.lower() for s in suffixes])) if suffixes else out
    return positions(out.withColumn("__k", T.casefold(F.col("path"))), [], ["__k", "path"], "pos", 0).drop("__k")


def plain_text(content: bytes) -> str:
    return bytes(content).decode("utf-8", "ignore")


def load_documents(spark: SparkSession, folder: str, metadata: DataFrame | None = None, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(doc_id, path, text, error, metadata): the files of a folder by suffix, joined to their metadata by path, then by name.

    ``parsers`` adds readers for suffixes (PDF and the like are not read without one).  A file
    that fails gives its error and no text, and stops nothing.
    """
    parsers = {".txt": plain_text, ".md": plain_text} | (parsers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                suffix = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    out.append((path, parsers[suffix](content), None))
                except Exception as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    known = "(?i)(" + "|".join(s.replace(".", r"\.") for s in parsers) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(known))
    docs = files.select("path", "content").mapInPandas(run, "path string, text string, error string").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    empty = F.create_map().cast("map<string,string>")
    if metadata is None or (column := file_column(metadata)) is None:
        return docs.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id"), "path", "text", "error", empty.alias("metadata"))
    packed = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in metadata.columns]), F.array(*[F.col(c).cast("string") for c in metadata.columns])), lambda _k, v: v.isNotNull())
    # the path as a whole, relative ones below the folder; of several rows for one file the first by content
    root = docs.withColumn("rel", F.regexp_replace("path", r"^[a-z]+:/*", "/"))
    rows = metadata.where(F.col(column).isNotNull()).select(F.regexp_replace(F.trim(F.col(column)), r"^(?:[a-z]+:/+|\\./)", "").alias("given"), packed.alias("m"))
    rows = rows.groupBy("given").agg(F.min_by("m", F.to_json("m")).alias("m"))
    depth = F.size(F.split("given", "/"))
    ends = rows.select("given", "m", depth.alias("depth"), F.regexp_extract("given", "([^/]+)$", 1).alias("m_name"))
    met = root.join(ends, F.col("name") == F.col("m_name"), "left")
    whole = (F.col("given").contains("/")) & F.expr("endswith(rel, concat('/', ltrim('/', given)))")
    best = met.groupBy("path", "text", "error", "name").agg(F.min_by("m", F.struct(F.when(whole, -F.col("depth")).otherwise(0), F.to_json("m"))).alias("m"))
    joined = best.withColumn("m", F.coalesce("m", empty))
    doc_id = F.coalesce(F.col("m")["doc_id"], F.col("m")["id"], F.regexp_replace("name", r"\.[^.]*$", ""))
    return joined.select(doc_id.alias("doc_id"), "path", "text", "error", F.col("m").alias("metadata"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the failed ones."""
    return df.where("error IS NULL").drop("error"), df.where("error IS NOT NULL")


def raw_tables(records: DataFrame) -> DataFrame:
    """Table records with content, numbered over all files: table_doc_id, then their columns.  Needs file_name, pos, content_type, text, section_path."""
    kept = records.where((F.col("content_type") == "table") & (F.length(T.strip(F.coalesce("text", F.lit("")))) > 0))
    placed = positions(kept, [], ["file_name", "pos"], "n")
    return placed.withColumn("table_doc_id", F.format_string("table_doc_%08d", "n")).withColumn("section_path_text", F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")).drop("n")


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Chunks with their vectors, numbered, as one parquet table; all vectors must have one size."""
    sizes = vectors.agg(F.countDistinct(F.size("embedding")).alias("n")).first()["n"]
    if sizes > 1:
        raise ValueError("vectors of several sizes")
    placed = positions(chunks.join(vectors, key), [], [key], "row_idx", 0) if "row_idx" not in chunks.columns else chunks.join(vectors, key)
    placed.write.mode("overwrite").parquet(path)


def merge_embedded(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of embedded tables by source name, with collision-free ids; vectors must have one size."""
    from functools import reduce

    from gleanery.operators.splitters import merged_ids

    # rows of one source and id are told apart by their content, which does not change from run to run
    tagged = [df.withColumn("source", F.lit(name)).withColumn("pos", F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])) for name, df in sorted(parts.items())]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if whole.agg(F.countDistinct(F.size("embedding")).alias("n")).first()["n"] > 1:
        raise ValueError("vectors of several sizes")
    return merged_ids(whole)


def append_index(chunks: DataFrame, path: str, rows: int = 4096) -> int:
    """Add embedded chunks to an index table, numbered on; returns the number of its rows.  Files hold about ``rows`` rows.

    The vectors must have the size of those that are there; ids that are there already fail.
    """
    spark = chunks.sparkSession
    there = load_index(spark, path)
    size = there.select(F.size("embedding").alias("n")).limit(1).collect()
    facts = chunks.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if facts["n"] and (facts["lo"] != facts["hi"] or size and size[0]["n"] != facts["hi"]):
        raise ValueError("vectors of several sizes")
    if not chunks.join(there.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
        raise ValueError("ids that the index has already")
    start = there.agg(F.coalesce(F.max("row_idx") + 1, F.lit(0)).alias("n")).first()["n"]
    placed = positions(chunks.drop("row_idx"), [], ["chunk_id"], "row_idx", start)
    placed.select(*there.columns).write.mode("append").option("maxRecordsPerFile", rows).parquet(path)
    return start + facts["n"]


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """An index table; one that is missing fails with its path."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def chunk_files(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """The rows of several JSON-lines files or folders, each file once however often it is named, with ``source_file``."""
    there = sorted({p for p in paths if _exists(spark, p)})
    rows = spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)
    return rows.withColumn("source_file", F.input_file_name())


def inflated(content: bytes) -> bytes | None:
    """An image out of a stored stream: as it is, or packed with a zlib header, without one, or as gzip; null if none is an image."""
    import zlib

    signs = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM", b"II*\x00", b"MM\x00*")
    if bytes(content[:8]).startswith(signs):
        return bytes(content)
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS, zlib.MAX_WBITS | 16):
        try:
            made = zlib.decompressobj(bits).decompress(bytes(content))
        except zlib.error:
            continue
        if made.startswith(signs):
            return made
    return None


def stored_images(streams: DataFrame) -> DataFrame:
    """(path, content): the images among stored streams (path, content), unpacked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.assign(content=[inflated(c) if c is not None else None for c in frame["content"]])
            yield out[out["content"].notna()]

    return streams.select("path", "content").mapInPandas(run, "path string, content binary")


def image_kind(content: Column) -> Column:
    """The kind of an image by its first bytes, null if unknown."""
    hexed = F.hex(F.substring(content, 1, 8))
    return F.when(hexed.startswith("89504E47"), "png").when(hexed.startswith("FFD8FF"), "jpg").when(hexed.startswith("47494638"), "gif").when(hexed.startswith("424D"), "bmp").when(hexed.startswith("49492A00") | hexed.startswith("4D4D002A"), "tiff")


def distinct_images(images: DataFrame, width: int = 80, height: int = 80, area: int = 12_000, size: int = 1024) -> DataFrame:
    """Images large enough, each content once (the first by path).  Needs path, content, width, height."""
    kept = images.where((F.col("width") >= width) & (F.col("height") >= height) & (F.col("width") * F.col("height") >= area) & (F.length("content") >= size)).withColumn("md5", F.md5("content"))
    first = kept.groupBy("md5").agg(F.min("path").alias("path"))
    return kept.join(first, ["md5", "path"], "left_semi")


def versioned_parts(path: Column) -> Column:
    """struct(engine, tag, doc, image) of a path .../engine/tag/doc/image.ext."""
    parts = r"([^/]+)/([^/]+)/([^/]+)/([^/]+?)(?:\.[^./]*)?$"
    return F.struct(*[F.regexp_extract(path, parts, i).alias(n) for i, n in enumerate(("engine", "tag", "doc", "image"), 1)])
