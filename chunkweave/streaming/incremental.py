"""Incremental deduplication of a stream of chunks: each batch is held against the index so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.operators.catalog import first_seen


def new_in_window(chunks: DataFrame, delay: str) -> DataFrame:
    """First occurrences of a stream chunks(ts, fp, ...) within the watermark; state is dropped behind it."""
    return chunks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fp"])


def ingest(stream: DataFrame, index_path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that appends each batch's new fingerprints (fp, path, seq, length, batch) to the index table.

    A batch that is run again replaces its own part, so a restart neither loses nor doubles chunks.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(index_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        prior = None
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(index_path)):
            table = spark.read.parquet(index_path)
            prior = table.where(F.col("batch") < number) if "batch" in table.columns else table
        first_seen(batch, prior).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
