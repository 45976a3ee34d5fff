"""Deduplication: what is new, where it goes, what is sent, and the figures of a run.

A file's chunk is unique where it is the first occurrence, by path and place, of a fingerprint that
isn't in the prior index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.cost import dedup_ratio, safe_ratio
from chunkweave.functions.hashing import seeded_rank_key
from chunkweave.functions.naming import top_folder
from chunkweave.operators.catalog import first_seen
from chunkweave.staging import numbered


def marked(chunks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """chunks with is_unique."""
    first = first_seen(chunks, prior).select("fp", F.col("path").alias("_path"), F.col("seq").alias("_seq"))
    is_first = (F.col("path") == F.col("_path")) & (F.col("seq") == F.col("_seq"))
    return chunks.join(first, "fp", "left").withColumn("is_unique", F.coalesce(is_first, F.lit(False))).drop("_path", "_seq")


def place_by_table(unique: DataFrame, placement: DataFrame, nodes: DataFrame) -> DataFrame:
    """unique(fp, ...) with node: that of placement(fp, node_ref), a node's id or its number; 0, the cloud, if there is none."""
    n = F.broadcast(nodes.select("node", "id"))  # a registry of nodes, not data
    ref = unique.join(placement.select("fp", F.trim("node_ref").alias("_ref")), "fp", "left")
    by_id = n.select(F.col("id").alias("_ref"), F.col("node").alias("_by_id"))
    by_no = n.select(F.col("node").cast("string").alias("_ref"), F.col("node").alias("_by_no"))
    both = ref.join(by_id, "_ref", "left").join(by_no, "_ref", "left")
    return both.withColumn("node", F.coalesce("_by_id", "_by_no", F.lit(0)).cast("int")).drop("_ref", "_by_id", "_by_no")


def place_round_robin(unique: DataFrame, nodes: int) -> DataFrame:
    """The k-th new chunk by path and place goes to node (k - 1) mod nodes + 1."""
    return numbered(unique, ["path", "seq"], "_k").withColumn("node", F.pmod(F.col("_k") - 1, F.lit(nodes)).cast("int") + 1).drop("_k")


def place_random(unique: DataFrame, nodes: int, seed: int) -> DataFrame:
    """A node by a seeded hash of the fingerprint: the same in every run and any SQL engine."""
    h = F.conv(F.substring(seeded_rank_key(seed, F.col("fp")), 1, 13), 16, 10).cast("long")
    return unique.withColumn("node", F.pmod(h, F.lit(nodes)).cast("int") + 1)


def place_modulo(ids: DataFrame, nodes: int) -> DataFrame:
    """ids(chunk_id, ...) with node: edges only, capacity ignored."""
    return ids.withColumn("node", (F.pmod(F.col("chunk_id") - 1, F.lit(nodes)) + 1).cast("int"))


def sent_bytes(length: Column, fp: Column, mode: str) -> Column:
    """Bytes on the wire for a chunk: its data, or its hash and size where edges make the data themselves."""
    if mode in ("real", "synthetic_manager"):
        return length
    if mode == "synthetic_edge":
        return (F.length(fp) + 8).cast("long")
    raise ValueError(f"no mode {mode!r}")


def file_stats(marked_chunks: DataFrame, placed: DataFrame, replicate: bool, mode: str = "real") -> DataFrame:
    """Figures of each file; placed(fp, node) has the unique chunks. A chunk in no edge is cloud-only if it is replicated.

    With a column `given` a file's own bytes count that size where it is positive, and else the unique
    chunk's length; what is stored and sent has the unique chunk's length always.
    """
    rows = marked_chunks.join(placed.select("fp", "node"), "fp", "left")
    new, length = F.col("is_unique"), F.col("length")
    logical = F.when(F.col("given") > 0, F.col("given")).otherwise(length) if "given" in marked_chunks.columns else length
    wire = sent_bytes(length, F.col("fp"), mode)
    cloud_only = new & (F.col("node") == 0) & F.lit(replicate)
    on_edge = new & (F.col("node") > 0)
    sent = F.when(on_edge, wire).otherwise(F.lit(0)) + F.when(new & F.lit(replicate), wire).otherwise(F.lit(0))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    out = rows.groupBy("path").agg(
        F.count("*").alias("chunks"),
        F.sum(logical).alias("original_bytes"),
        total(new, length).alias("unique_bytes"),
        F.count(F.when(cloud_only, 1)).alias("cloud_only_unique_chunks"),
        total(cloud_only, length).alias("cloud_only_unique_bytes"),
        F.sum(sent).alias("network_sent_bytes"),
    )
    return out.withColumn("dedup_ratio", dedup_ratio(F.col("original_bytes"), F.col("unique_bytes")))


def overall(stats: DataFrame) -> DataFrame:
    """One row over file_stats(): totals and averages for each file."""
    names = ["chunks", "original_bytes", "unique_bytes", "cloud_only_unique_chunks", "cloud_only_unique_bytes", "network_sent_bytes"]
    t = stats.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    out = t.withColumn("dedup_ratio", dedup_ratio(F.col("original_bytes"), F.col("unique_bytes")))
    edge = F.col("unique_bytes") - F.col("cloud_only_unique_bytes")
    out = out.withColumn("edge_share", safe_ratio(edge, F.col("original_bytes")))
    return out.select("*", *(safe_ratio(F.col(c), F.col("files")).alias(f"avg_{c}") for c in names))


def folder_stats(stats: DataFrame) -> DataFrame:
    folder = top_folder(F.col("path")).alias("folder")
    return stats.groupBy(folder).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("original_bytes").alias("original_bytes"), F.sum("unique_bytes").alias("unique_bytes"))


def batches(placed: DataFrame, size: int) -> DataFrame:
    """(path, node, chunks, batches): requests of at most `size` chunks, the last flushed at a file's end."""
    return placed.groupBy("path", "node").agg(F.count("*").alias("chunks")).withColumn("batches", F.ceil(F.col("chunks") / F.lit(float(size))).cast("long"))


def extended_index(index: DataFrame, placed: DataFrame) -> DataFrame:
    """index(fp, node) with the new chunks; what it has already stays."""
    fresh = placed.select("fp", "node").join(index.select("fp"), "fp", "left_anti")
    return index.select("fp", "node").unionByName(fresh)


def split_failures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable files, and failed ones (path, reason); a failed file leaves nothing in the figures."""
    bad = F.col("content").isNull()
    return files.where(~bad), files.where(bad).select("path", F.lit("content can't be read").alias("reason"))


def puts(index: DataFrame, batch: DataFrame) -> DataFrame:
    """A node's answer to put requests: fingerprints with whether they were there already; items without a fingerprint are skipped."""
    items = batch.where(F.coalesce(F.trim("fp"), F.lit("")) != "")
    return items.join(index.select("fp", F.lit(True).alias("existed")), "fp", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def gets(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(fp) with found and where the chunk is."""
    return asked.join(index.select("fp", "location"), "fp", "left").withColumn("found", F.col("location").isNotNull())
