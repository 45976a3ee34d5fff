"""Tables written to the shared folder, and row numbers without a single-task sort."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def staging(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"chunkweave-{sc.applicationId}"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> Callable[[], DataFrame]:
    """Write df to the staging folder; each call reads it as a table of its own, which may be joined with the others."""
    path, schema = f"{staging(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return lambda: df.sparkSession.read.schema(schema).parquet(path)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the staging folder and read it back: its lineage ends there."""
    return written(df, tag)()


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df sorted by ranges and written once: `_part` is a row's range, `_place` its place in there."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    return staged(rows.withColumn("_part", F.shiftright(mono, 33).cast("int")).withColumn("_place", mono.bitwiseAND(F.lit(low))), "ranged")


def _shifted(placed: DataFrame, name: str, values: list[tuple]) -> DataFrame:
    """placed with a value for each range, of which there is one row."""
    kind = placed.schema["_value"].dataType.simpleString() if "_value" in placed.columns else "bigint"
    table = placed.sparkSession.createDataFrame(values, f"_part int, {name} {kind}")
    return placed.join(F.broadcast(table), "_part")


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """df with its place in the whole order (long).

    Rows are range-partitioned, sorted and written once; only one count for each partition comes to
    the driver, and a row's number is its partition's offset plus its place there.
    """
    placed = ranged(df, order)
    at, offsets = start, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], at))
        at += r["count"]
    return _shifted(placed, "_offset", offsets).withColumn(name, F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset")


def cumulated(df: DataFrame, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with the running sum of value (double) in the whole order: sums within ranges, after those of all ranges before."""
    placed = ranged(df.withColumn("_value", value.cast("double")), order)
    at, before = 0.0, []
    for r in placed.groupBy("_part").agg(F.sum("_value").alias("s")).orderBy("_part").collect():  # one row for each range
        before.append((r["_part"], at))
        at += r["s"] or 0.0
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy("_place"))
    return _shifted(placed, "_before", before).withColumn(name, within + F.col("_before")).drop("_part", "_place", "_value", "_before")


def preceded(df: DataFrame, order: list[str | Column], value: Column, name: str, first: float) -> DataFrame:
    """df with the value (double) of the row before in the whole order; `first` for the first row."""
    placed = ranged(df.withColumn("_value", value.cast("double")), order)
    last, before = first, []
    for r in placed.groupBy("_part").agg(F.max_by("_value", "_place").alias("v")).orderBy("_part").collect():  # one row for each range
        before.append((r["_part"], last))
        last = r["v"]
    here = F.lag("_value").over(Window.partitionBy("_part").orderBy("_place"))
    return _shifted(placed, "_before", before).withColumn(name, F.when(F.col("_place") == 0, F.col("_before")).otherwise(here)).drop("_part", "_place", "_value", "_before")
