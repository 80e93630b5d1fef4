"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage: a lost executor only costs the tasks that read it.
The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests
on one machine) a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for ``local`` masters without the setting."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    spark.conf.set(_SETTING, folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context may be gone already
        pass


_OPEN: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`shared_table` wrote within it; read or write the results before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)


def shared_table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  Removed at the end of the innermost :func:`scope`, else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleanery-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    atexit.register(_remove, spark, path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
