"""Workloads: which files are asked for, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.staging import cumulated, numbered, preceded


def uniform(seed: int, *key: Column) -> Column:
    """A reproducible number in (0, 1) from a seed and a key: the first 13 hex digits of a SHA-1, the same in any SQL engine."""
    h = F.sha1(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_arrivals(requests: DataFrame, rate: float, seed: int) -> DataFrame:
    """requests(req_id, ...) with arrival_s: sums of exponential gaps in order of req_id, six decimals.

    Sums are made within ranges of requests and shifted by the ranges before, so no task has all.
    """
    gap = -F.log(1.0 - uniform(seed, F.col("req_id"))) / rate
    return cumulated(requests, ["req_id"], gap, "arrival_s").withColumn("arrival_s", F.round("arrival_s", 6))


def paced(arrivals: DataFrame, scale: float = 1.0, most: int | None = None) -> DataFrame:
    """arrivals(req_id, arrival_s) with wait_s until each from the one before; the first `most` only, if given."""
    rows = arrivals if most is None else arrivals.orderBy("arrival_s", "req_id").limit(most)
    rows = preceded(rows, ["arrival_s", "req_id"], F.col("arrival_s"), "_last", 0.0)
    return rows.withColumn("wait_s", F.greatest(F.col("arrival_s") - F.col("_last"), F.lit(0.0)) / scale).drop("_last")


def weights(files: DataFrame) -> DataFrame:
    """files(path, heat) with weight: no negative ones, and all equal if every one is zero."""
    w = files.withColumn("weight", F.greatest(F.coalesce(F.col("heat"), F.lit(0.0)), F.lit(0.0)))
    total = w.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    return w if total > 0 else w.withColumn("weight", F.lit(1.0))


def sample_with_replacement(files: DataFrame, n: int, seed: int) -> DataFrame:
    """(req_id, path): n draws by weight, by the place of a uniform number among cumulative weights.

    Cumulative weights and draws meet in cells of equal width, so the range join is an equi-join.
    """
    spark = files.sparkSession
    cells = max(1, min(n, 4096))
    cum = cumulated(weights(files), ["path"], F.col("weight"), "_hi").withColumn("_lo", F.col("_hi") - F.col("weight"))
    total = cum.agg(F.max("_hi")).first()[0] or 1.0
    width = total / cells
    spans = cum.where("weight > 0").select("path", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_cell"))
    draws = spark.range(1, n + 1).select(F.col("id").alias("req_id"), (uniform(seed, F.col("id")) * total).alias("_u"))
    draws = draws.withColumn("_cell", F.floor(F.col("_u") / width))
    hit = draws.join(spans, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return hit.groupBy("req_id").agg(F.min("path").alias("path"))


def sample_without_replacement(files: DataFrame, n: int, seed: int) -> DataFrame:
    """(rank, path): n files by weight, the largest ln(u) / weight first."""
    key = F.log(uniform(seed, F.col("path"))) / F.col("weight")
    top = weights(files).where("weight > 0").select("path", key.alias("_k")).orderBy(F.desc("_k"), "path").limit(n)
    return numbered(top, [F.desc("_k"), F.asc("path")], "rank").select("rank", "path")
