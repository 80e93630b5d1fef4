"""From parsed records in order to retrieval chunks, by islands instead of a per-file machine.

Records: file_name, pos, content_type (section_text, cover_text, toc, table), section_path
(array), text, and for tables table_id, table_type, shape, n_cols, header (array), rows (array).
Neighbours meet across range partitions (``functions.islands``); only one section or one
table at a time is put together, so a file of any length needs no task that holds it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanery.functions import text as T
from gleanery.functions.islands import scan
from gleanery.functions.numbering import positions
from gleanery.operators import tables
from gleanery.operators.splitters import pack_rows, section

SHORT = 140


def table_groups(records: DataFrame) -> DataFrame:
    """Adds group and role (start, continued) to tables that go on across page breaks.

    A table goes on with the one before in its file if path and columns are equal, types are
    equal or both open, headers (if both have one) overlap by half, and only blank or short
    text lies between.  Other records have nulls.
    """
    found = tables.continued(records.where("content_type = 'table'").drop("text", "rows"), records.where("content_type <> 'table'").select("file_name", "pos", "content_type", "text"))
    marks = found.select(F.col("file_name").alias("__f"), F.col("pos").alias("__p"), "group", "role")
    return records.join(marks, F.col("file_name").eqNullSafe(F.col("__f")) & (F.col("pos") == F.col("__p")), "left").drop("__f", "__p")


def chunks(records: DataFrame, size: int = 1200, overlap: int = 150, least: int = 80, table_size: int = 1200, most_rows: int = 30, legacy: bool = False) -> DataFrame:
    """(chunk_id, file_name, pos, part, chunk_type, section_path_text, table_id, text): chunks numbered over all files.

    Text of one section in a row is one text; of at most SHORT characters before a table it
    becomes that table's context; before a table its last chunk names the table.  Tables give
    chunks of packed rows, or of their text if they have no rows.  Blank sections give none.
    ``legacy`` leaves out the names of tables, as older chunks do.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: section(t, size, overlap, least) if t else [])

    @F.pandas_udf(ArrayType(StringType()))
    def packs(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: ["\n".join(p) for p in pack_rows([x for x in r if x], table_size, most_rows)] if r is not None else [])

    bucket = F.when(F.col("content_type") != "table", F.to_json(F.struct("content_type", "section_path")))
    seen = scan(records.withColumn("__k", bucket), ["file_name"], ["pos"], lag=["__k"])
    flagged = seen.withColumn("__new", F.when(F.coalesce(F.col("__k") == F.col("prev___k"), F.lit(False)), 0).otherwise(1)).drop("__k", "prev___k")
    marked = scan(flagged, ["file_name"], ["pos"], total=["__new"]).withColumnRenamed("upto___new", "island")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    first = lambda c: F.min_by(c, "pos").alias(c)
    islands = marked.groupBy("file_name", "island").agg(F.min("pos").alias("start"), first("content_type"), first("section_path"), first("table_id"), first("table_type"), first("shape"), first("rows"), T.clean_block(body).alias("body"))
    told = islands.withColumn("me", F.struct("content_type", "body", "table_id", "table_type", "shape"))
    seen = scan(told, ["file_name"], ["start"], lag=["me"]).withColumnRenamed("prev_me", "before").withColumn("back", -F.col("start"))
    seen = scan(seen, ["file_name"], ["back"], lag=["me"]).withColumnRenamed("prev_me", "after").drop("me", "back")
    seen = seen.withColumn("context", F.when((F.col("before.content_type") != "table") & (F.length("before.body") <= SHORT), F.col("before.body")))
    low = F.length(T.compact(F.col("body"))) == 0
    texts = seen.where((F.col("content_type") != "table") & ~low & ~F.coalesce((F.col("after.content_type") == "table") & (F.length("body") <= SHORT), F.lit(False)) & ~T.compact(F.col("body")).isin("목차", "차례", "tableofcontents"))
    name = F.concat(F.lit("[next table: "), F.concat_ws(", ", "after.table_id", "after.table_type", "after.shape"), F.lit("]"))
    parts = texts.select("file_name", "start", "section_path", F.when(F.col("content_type") == "cover_text", "cover_text").otherwise("section_text").alias("chunk_type"), F.lit(None).cast("string").alias("table_id"), cut("body").alias("p"), (F.lit(None).cast("string") if legacy else F.when(F.col("after.content_type") == "table", name)).alias("tail"), F.lit(None).cast("string").alias("context"))
    rows = F.coalesce("rows", F.array().cast("array<string>"))
    grids = seen.where("content_type = 'table'").select("file_name", "start", "section_path", F.concat(F.when(F.size(rows) > 0, "table_rows/").otherwise("table_markdown/"), F.coalesce("table_type", F.lit("data"))).alias("chunk_type"), "table_id", F.when(F.size(rows) > 0, packs(rows)).otherwise(cut("body")).alias("p"), F.lit(None).cast("string").alias("tail"), "context")
    spread = parts.unionByName(grids).select("*", F.posexplode("p").alias("part", "piece"))
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    last = F.when(F.col("part") == F.size("p") - 1, F.col("tail"))
    text = F.concat_ws("\n\n", F.nullif(F.concat_ws("\n", F.col("file_name"), F.nullif(path, F.lit(""))), F.lit("")), F.when(F.length("context") > 0, F.col("context")), "piece", last)
    made = spread.select("file_name", F.col("start").alias("pos"), (F.col("part") + 1).alias("part"), "chunk_type", path.alias("section_path_text"), "table_id", text.alias("text"))
    return positions(made, [], ["file_name", "pos", "part"], "n").select(F.format_string("chunk_%08d", "n").alias("chunk_id"), "file_name", "pos", "part", "chunk_type", "section_path_text", "table_id", "text")
