"""Shared plumbing of the training-data operators: staging folder, keys, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: long texts must not pile up in one Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: Remembered word hashes of one Python worker, about 150 bytes each.
WORDS_MAX = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_hashes() -> dict[bytes, int]:
    """Hashes of words, one memory for all operators that a Python worker runs."""
    return _WordHashes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes where they are larger (0: unlimited)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def staging(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"chunkweave-{sc.applicationId}")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the staging folder and read it back: lineage ends there and the work is done once."""
    spark = df.sparkSession
    path = f"{staging(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete what staged() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sliced(data: bytes, bounds: np.ndarray) -> list[bytes]:
    """The parts of data between bounds."""
    at = bounds.tolist()
    return [data[a:z] for a, z in zip(at, at[1:], strict=False)]


def listed(column: pa.Array) -> list:
    """column.to_pylist(); of integers, binaries and lists without an Arrow scalar for each value."""
    kind, n = column.type, len(column)
    if pa.types.is_integer(kind):
        out = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(kind) else np.int32, column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
        out = sliced(data[int(bounds[0]) : int(bounds[-1])].to_pybytes() if data is not None else b"", bounds - bounds[0])
    elif pa.types.is_list(kind):
        at = column.offsets.to_numpy().tolist() if n else [0]
        values = listed(column.values.slice(at[0], at[-1] - at[0]))
        out = [values[a - at[0] : z - at[0]] for a, z in zip(at, at[1:], strict=False)]
    else:
        return column.to_pylist()
    if column.null_count:
        for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[k] = None
    return out


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    full = [*bounds, *[None] * ((1 << steps) - 1 - len(bounds))]
    table = F.expr("array(" + ",".join("CAST(NULL AS BIGINT)" if b is None else f"CAST('{b}' AS BIGINT)" for b in full) + ")")  # folded to one literal: nothing is built for each row
    widths = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    return F.aggregate(widths, F.lit(0), lambda at, w: F.when(F.element_at(table, at + w) <= key, at + w).otherwise(at))


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished rounds, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    edges: (u, v) of any orderable type, undirected. Alternates large-star and small-star
    until the edge set stands still; each round is one written table of edges, so a lost
    executor costs a round at most and nothing is gathered on the driver. Self loops and
    nulls are ignored; no edges give an empty result.
    """
    e = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e, mark = staged(e, "edges"), None
    for turn in range(rounds + 1):
        if turn == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        nxt = staged(small, "edges")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        unstage(e)
        e = nxt
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root"), F.col("root")).distinct())
