"""Incremental ingest: an extension, for corpora that grow.

Files of a folder are read as a stream of texts, split into chunks and written as parquet;
a checkpoint makes each file count once.  Repeated rows of a micro-batch are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.splitters import split


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id string, text string, loaded_at timestamp") -> DataFrame:
    """Documents of JSON-lines files as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def ingest(documents: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Split every new document and add its chunks to ``out``, a partition per micro-batch; ends when all present files are done.

    A batch that is tried again replaces its own partition, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["doc_id", "text"])
        split(once, "doc_id", **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def counts_by_hour(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """(hour, n): documents per hour of loading; rows later than ``late`` behind the stream are left out."""
    return documents.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n")
