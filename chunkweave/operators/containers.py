"""Containers of chunks on a node: packing, resuming, and what reads through a small cache cost."""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.cost import safe_ratio

# Fixed values of the container format.
HEADER_BYTES, ENTRY_BYTES, FIRST_MULTI_ID = 16, 28, 1000


def most_entries(meta_bytes: int) -> int:
    return (meta_bytes - HEADER_BYTES) // ENTRY_BYTES


def next_fit(lengths: list[int], data_bytes: int, meta_bytes: int, first_id: int = 0) -> list[tuple[int, int]]:
    """(container, offset) of each chunk in order: a new container where bytes or entries don't fit; a chunk that is too long is alone."""
    out, container, used, n = [], first_id, 0, 0
    for length in lengths:
        if n and (used + length > data_bytes or HEADER_BYTES + ENTRY_BYTES * (n + 1) > meta_bytes):
            container, used, n = container + 1, 0, 0
        out.append((container, used))
        used, n = used + length, n + 1
    return out


def pack(placed: DataFrame, data_bytes: int = 4 << 20, meta_bytes: int = 32 << 10, first_id: int = 0) -> DataFrame:
    """(node, container_id, fp, offset, length) of placed(node, path, seq, fp, length), in order of path and place.

    A node's containers follow one another, so a node is one task; its rows are narrow.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["path", "seq"])
        at = next_fit(rows["length"].tolist(), data_bytes, meta_bytes, first_id)
        return pd.DataFrame({"node": rows["node"].to_numpy(), "container_id": [c for c, _ in at], "fp": rows["fp"].to_numpy(), "offset": [o for _, o in at], "length": rows["length"].to_numpy()})

    return placed.select("node", "path", "seq", "fp", "length").groupBy("node").applyInPandas(fold, "node int, container_id long, fp string, offset long, length long")


def resume_id(file_bytes: Column, container_bytes: int, has_index: Column, single_file: bool) -> Column:
    """First free container: from the size of the one file, or past the ids that many files start with."""
    if single_file:
        return F.floor(file_bytes / F.lit(float(container_bytes))).cast("long") + 1
    return F.when(has_index, F.lit(FIRST_MULTI_ID)).otherwise(F.lit(0)).cast("long")


def simulate_reads(reads: list[tuple[int, int]], loaded: dict[int, int], cache: int, meta_bytes: int) -> dict[str, int]:
    """Counters of reads(container, length) through a least-recently-used cache; it always holds the last container."""
    held: OrderedDict[int, None] = OrderedDict()
    out = dict.fromkeys(("cache_hits", "cache_misses", "useful_bytes", "container_loaded_bytes", "meta_read_bytes"), 0)
    for container, length in reads:
        if container in held:
            out["cache_hits"] += 1
            held.move_to_end(container)
        else:
            out["cache_misses"] += 1
            out["container_loaded_bytes"] += loaded[container]
            out["meta_read_bytes"] += meta_bytes
            while held and len(held) >= max(cache, 1):
                held.popitem(last=False)
            held[container] = None
        out["useful_bytes"] += length
    return out


def read_stats(reads: DataFrame, packed: DataFrame, cache: int, meta_bytes: int = 32 << 10) -> DataFrame:
    """Counters of each node for reads(node, at, fp) in order of `at`."""
    found = reads.join(packed, ["node", "fp"]).select("node", "at", "container_id", "length")
    sizes = packed.groupBy("node", "container_id").agg(F.sum("length").alias("bytes"))
    rows = found.join(sizes, ["node", "container_id"])
    names = ["cache_hits", "cache_misses", "useful_bytes", "container_loaded_bytes", "meta_read_bytes"]

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at")
        loaded = dict(zip(x["container_id"].tolist(), x["bytes"].tolist(), strict=True))
        got = simulate_reads(list(zip(x["container_id"].tolist(), x["length"].tolist(), strict=True)), loaded, cache, meta_bytes)
        return pd.DataFrame([{"node": int(x["node"].iloc[0]), **got}])

    return rows.groupBy("node").applyInPandas(fold, "node int, " + ", ".join(f"{c} long" for c in names))


def derived_stats(stats: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Ratios of each node and of all (node null): hit rate, useful share, read amplification. A baseline's counters are taken off, 0 at least."""
    names = ["cache_hits", "cache_misses", "useful_bytes", "container_loaded_bytes", "meta_read_bytes"]
    if baseline is not None:
        stats = stats.join(baseline.select("node", *(F.col(c).alias(f"_{c}") for c in names)), "node", "left")
        stats = stats.select("node", *(F.greatest(F.col(c) - F.coalesce(f"_{c}", F.lit(0)), F.lit(0)).alias(c) for c in names))
    t = stats.rollup("node").agg(*(F.sum(c).alias(c) for c in names), F.grouping("node").alias("is_all"))
    t = t.where((F.col("is_all") == 1) | F.col("node").isNotNull()).withColumn("edge", F.when(F.col("is_all") == 1, "ALL").otherwise(F.col("node").cast("string")))
    read = F.col("container_loaded_bytes") + F.col("meta_read_bytes")
    return t.select(
        "edge",
        *names,
        safe_ratio(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")).alias("hit_rate"),
        safe_ratio(F.col("useful_bytes"), F.col("container_loaded_bytes")).alias("useful_ratio"),
        safe_ratio(read, F.col("useful_bytes")).alias("read_amplification"),
    )


def container_images(packed: DataFrame, data: DataFrame, data_bytes: int = 4 << 20, meta_bytes: int = 32 << 10, single_file: bool = False) -> DataFrame:
    """(node, container_id, image): a container's bytes, then its big-endian header (id, chunks, bytes) and entries
    (fingerprint, length, offset), padded to the meta size. In the one file of a node the bytes are padded too."""
    rows = packed.join(data.select("fp", "data"), "fp")

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("offset")
        node, cid, body = int(x["node"].iloc[0]), int(x["container_id"].iloc[0]), b"".join(x["data"])
        meta = struct.pack(">qII", cid, len(x), len(body))
        meta += b"".join(bytes.fromhex(f) + struct.pack(">II", int(n), int(o)) for f, o, n in zip(x["fp"], x["offset"], x["length"], strict=True))
        return pd.DataFrame([{"node": node, "container_id": cid, "image": (body.ljust(data_bytes, b"\0") if single_file else body) + meta.ljust(meta_bytes, b"\0")}])

    return rows.groupBy("node", "container_id").applyInPandas(fold, "node int, container_id long, image binary")


def read_image(images: DataFrame, meta_bytes: int = 32 << 10) -> DataFrame:
    """(node, container_id, fp, data): chunks cut out of their containers again, with bounds checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, cid, image in zip(b["node"], b["container_id"], b["image"], strict=True):
                meta = image[-meta_bytes:]
                own, n, size = struct.unpack_from(">qII", meta)
                if own != cid or size > len(image) - meta_bytes:
                    raise ValueError("a container isn't the one or as long as it says")
                for k in range(n):
                    at = HEADER_BYTES + ENTRY_BYTES * k
                    length, offset = struct.unpack_from(">II", meta, at + 20)
                    if offset + length > size:
                        raise ValueError("a chunk reaches past its container")
                    out.append((node, cid, meta[at : at + 20].hex(), image[offset : offset + length]))
            yield pd.DataFrame(out, columns=["node", "container_id", "fp", "data"])

    return images.mapInPandas(run, "node int, container_id long, fp string, data binary")
