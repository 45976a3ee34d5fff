"""The chunk catalog: files, chunks, first-seen ids, heat and totals.

Tables: files(file_id, path, raw_size, ...), chunks(path, seq, length, fp), edges = chunks with chunk_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.hashing import seeded_rank_key
from chunkweave.staging import numbered


def with_file_ids(files: DataFrame) -> DataFrame:
    """file_id from 1 in byte order of the path."""
    return numbered(files, ["path"], "file_id")


def first_seen(chunks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(fp, path, seq, length) of each fingerprint's first occurrence by path and place; without those in prior(fp)."""
    at = F.struct("path", "seq", "length").alias("at")
    first = chunks.groupBy("fp").agg(F.min(at).alias("at")).select("fp", "at.*")
    return first if prior is None else first.join(prior.select("fp").distinct(), "fp", "left_anti")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """(chunk_id, fp, size): ids from 1 by first occurrence."""
    return numbered(first_seen(chunks), ["path", "seq"], "chunk_id").select("chunk_id", "fp", F.col("length").alias("size"))


def edges(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks with chunk_id."""
    return chunks.join(ids.select("fp", "chunk_id"), "fp")


def zipf_heat(files: DataFrame, s: float, seed: int | None = None) -> DataFrame:
    """files(file_id, path, raw_size) with heat 1 / rank^s, the rank by path or, with a seed, by a hash of it."""
    if seed is None:
        ranked = files.withColumn("rank", F.col("file_id"))
    else:
        ranked = numbered(files, [seeded_rank_key(seed, F.col("path"))], "rank")
    return with_density(ranked.withColumn("heat", 1.0 / F.pow(F.col("rank").cast("double"), F.lit(s))).drop("rank"))


def with_density(files: DataFrame) -> DataFrame:
    """heat_dsize: heat for each byte, 0 for an empty file."""
    return files.withColumn("heat_dsize", F.when(F.col("raw_size") > 0, F.col("heat") / F.col("raw_size")).otherwise(F.lit(0.0)))


def override_heat(files: DataFrame, popularity: DataFrame) -> DataFrame:
    """Heat of popularity(file, heat), by path, where it has one; densities follow."""
    given = popularity.select(F.col("file").alias("path"), F.col("heat").alias("_given"))
    return with_density(files.join(given, "path", "left").withColumn("heat", F.coalesce("_given", "heat")).drop("_given"))


def shuffle_heat(files: DataFrame, seed: int) -> DataFrame:
    """The same heats dealt to other files: the n-th file by path gets the heat of the n-th by a seeded hash."""
    heats = numbered(files.select(F.col("path").alias("_p"), F.col("heat").alias("_heat")), [seeded_rank_key(seed, F.col("_p"))], "_n").select("_n", "_heat")
    ranked = numbered(files, ["path"], "_n")
    return with_density(ranked.join(heats, "_n").withColumn("heat", F.col("_heat")).drop("_n", "_heat"))


def totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, logical and unique bytes, unique chunks, ratio."""
    per = chunks.groupBy("fp").agg(F.count("*").alias("n"), F.max("length").alias("size"))
    t = per.agg(F.sum("n").alias("chunks"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total_bytes"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"))
    return t.withColumn("ratio", F.when(F.col("unique_bytes") > 0, F.col("total_bytes") / F.col("unique_bytes")).otherwise(F.lit(1.0)))


def distinct_totals(chunks: DataFrame) -> DataFrame:
    """One row: files' bytes counting a chunk once for each file, and unique bytes."""
    per = chunks.groupBy("fp").agg(F.countDistinct("path").alias("files"), F.max("length").alias("size"))
    return per.agg(F.sum(F.col("files") * F.col("size")).alias("file_bytes"), F.sum("size").alias("unique_bytes"), F.count("*").alias("unique_chunks"))


def degrees(chunks: DataFrame) -> DataFrame:
    """(fp, size, degree, uses): how many files have a chunk, and how often."""
    return chunks.groupBy("fp").agg(F.max("length").alias("size"), F.countDistinct("path").alias("degree"), F.count("*").alias("uses"))


def postings(chunks: DataFrame) -> DataFrame:
    """(fp, paths): the files of each chunk in path order."""
    return chunks.groupBy("fp").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Offsets rebuilt from the lengths."""
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def by_heat(files: DataFrame) -> DataFrame:
    """Rank from 1 by heat, the hottest first, ties by file_id."""
    return numbered(files, [F.col("heat").desc(), F.col("file_id").asc()], "heat_rank")


def protected(files: DataFrame, ratio: float | None = None, top: int | None = None) -> DataFrame:
    """The hottest files: `top` of them, or a share of all, one at least."""
    if top is None:
        n = files.count()
        top = max(1, -int(-(n * (ratio or 0.0)) // 1)) if n else 0
    return by_heat(files).where(F.col("heat_rank") <= top)


def capped(files: DataFrame, most: int) -> DataFrame:
    """The first `most` files by path; catalog totals stay those of all files."""
    return files.orderBy("path").limit(most)


def assert_catalog(ids: DataFrame) -> DataFrame:
    """ids(chunk_id, fp, size) unless a fingerprint is blank, a size not positive or a fingerprint has two sizes."""
    good = F.assert_true((F.trim("fp") != "") & (F.col("size") > 0), "a blank fingerprint or a size that isn't positive")
    return ids.where(good.isNull())
