"""Restore: which source a file comes from, what is asked of which node, and the bytes put together again.

recipe(path, seq, fp, length), index(fp, node): node 0 is the cloud, edges count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.cost import mib_per_s, safe_ratio
from chunkweave.functions.hashing import edge_by_ratio

STREAM_BYTES = 2 << 20


def on_edge(node: Column, nodes: int) -> Column:
    return F.coalesce(node.between(1, nodes), F.lit(False))


def policy(recipe: DataFrame, index: DataFrame, nodes: int, threshold: int = 1, forced: bool = False) -> DataFrame:
    """(path, chunks, bytes, non_edge, cloud_full): a file comes whole from the cloud where that many of its places, repeats counted, are on no edge."""
    threshold = max(threshold, 1)
    rows = recipe.join(index, "fp", "left")
    out = rows.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.count(F.when(~on_edge(F.col("node"), nodes), 1)).alias("non_edge"))
    return out.withColumn("cloud_full", F.lit(True) if forced else F.col("non_edge") >= threshold)


def windows(recipe: DataFrame, size: int) -> DataFrame:
    """recipe with window: blocks of `size` consecutive places."""
    return recipe.withColumn("window", F.floor(F.col("seq") / F.lit(float(size))).cast("long"))


def window_distinct(recipe: DataFrame, size: int) -> DataFrame:
    """(path, window, fp, first_seq, uses, length): each fingerprint once in a window, where it is first."""
    return windows(recipe, size).groupBy("path", "window", "fp").agg(F.min("seq").alias("first_seq"), F.count("*").alias("uses"), F.max("length").alias("length"))


def edge_fetches(recipe: DataFrame, index: DataFrame, window: int, batch: int) -> DataFrame:
    """(path, window, node, chunks, bytes, batches): requests to each node; a chunk without a node has node null."""
    rows = window_distinct(recipe, window).join(index, "fp", "left")
    out = rows.groupBy("path", "window", "node").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
    return out.withColumn("batches", F.ceil(F.col("chunks") / F.lit(float(batch))).cast("long"))


def cloud_fetches(sizes: DataFrame) -> DataFrame:
    """sizes(path, bytes) with the messages of a streamed object."""
    return sizes.withColumn("batches", F.ceil(F.col("bytes") / F.lit(float(STREAM_BYTES))).cast("long"))


def file_stats(decided: DataFrame, fetches: DataFrame) -> DataFrame:
    """policy() with batches, fetched bytes and the nodes asked."""
    per = fetches.groupBy("path").agg(F.sum("batches").alias("_b"), F.sum("bytes").alias("_n"), F.countDistinct("node").alias("_k"))
    out = decided.join(per, "path", "left")
    streamed = F.ceil(F.col("bytes") / F.lit(float(STREAM_BYTES))).cast("long")
    return out.select(
        "path", "chunks", "bytes", "non_edge", "cloud_full",
        F.when(F.col("cloud_full"), streamed).otherwise(F.coalesce("_b", F.lit(0))).alias("batches"),
        F.when(F.col("cloud_full"), F.col("bytes")).otherwise(F.coalesce("_n", F.lit(0))).alias("fetched_bytes"),
        F.when(F.col("cloud_full"), F.lit(1)).otherwise(F.coalesce("_k", F.lit(0))).cast("long").alias("nodes"),
    )


def overall(stats: DataFrame) -> DataFrame:
    t = stats.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("batches"), F.lit(0)).alias("batches"), F.count(F.when(F.col("cloud_full"), 1)).alias("cloud_full_files"),
    )
    return t.select("*", *(safe_ratio(F.col(c), F.col("files")).alias(f"avg_{c}") for c in ("chunks", "bytes", "batches")))


def merged_node_stats(parts: DataFrame) -> DataFrame:
    """Sums of each node's partial counters; an id, where any part has one, stays."""
    names = [c for c in parts.columns if c not in ("node", "id")]
    return parts.groupBy("node").agg(F.max("id").alias("id"), *(F.sum(c).alias(c) for c in names))


def node_stats(merged: DataFrame) -> DataFrame:
    """Averages and shares of merged(node, id, batches, chunks_requested, bytes_returned, rpc_s, server_s)."""
    return merged.select(
        "*",
        safe_ratio(F.col("chunks_requested"), F.col("batches")).alias("avg_chunks"),
        safe_ratio(F.col("bytes_returned"), F.col("batches")).alias("avg_bytes"),
        safe_ratio(F.col("rpc_s"), F.col("batches")).alias("avg_rpc_s"),
        (safe_ratio(F.col("server_s"), F.col("rpc_s")) * 100).alias("server_pct"),
        mib_per_s(F.col("bytes_returned"), F.col("rpc_s"), None).alias("mib_s"),
    ).orderBy("node", "id")


def hybrid_sources(recipe: DataFrame, index: DataFrame, nodes: int, ratio: float) -> DataFrame:
    """recipe with source: edge for chunks that are placed on one and in the hash's share, else cloud."""
    rows = recipe.join(index, "fp", "left")
    return rows.withColumn("source", F.when(edge_by_ratio(F.col("fp"), ratio) & on_edge(F.col("node"), nodes), "edge").otherwise("cloud"))


def experiment(recipe: DataFrame, index: DataFrame, nodes: int, mode: str, ratio: float = 1.0) -> DataFrame:
    """(path, edge_chunks, edge_bytes, cloud_chunks, cloud_bytes) of a run in mode edge-all, cloud-full or hybrid."""
    share = {"edge-all": 1.0, "cloud-full": 0.0, "hybrid": ratio}[mode]
    rows = hybrid_sources(recipe, index, nodes, share)
    total = lambda s, v: F.coalesce(F.sum(F.when(F.col("source") == s, v)), F.lit(0))
    return rows.groupBy("path").agg(
        F.count(F.when(F.col("source") == "edge", 1)).alias("edge_chunks"), total("edge", F.col("length")).alias("edge_bytes"),
        F.count(F.when(F.col("source") == "cloud", 1)).alias("cloud_chunks"), total("cloud", F.col("length")).alias("cloud_bytes"),
    )


def elapsed_split(elapsed: Column, edge_bytes: Column, cloud_bytes: Column, edge_requests: Column, cloud_requests: Column) -> tuple[Column, Column]:
    """Elapsed time of a hybrid fetch on edge and cloud: by bytes, else by requests, else all on the edge."""
    n_bytes, n_req = edge_bytes + cloud_bytes, edge_requests + cloud_requests
    share = F.when(n_bytes > 0, edge_bytes / n_bytes).when(n_req > 0, edge_requests / n_req).otherwise(F.lit(1.0))
    return elapsed * share, elapsed * (1 - share)


def requested(catalog: DataFrame, requests: DataFrame, prefix: str = "") -> DataFrame:
    """requests(req_id, input) with the file that has the path itself or behind the prefix; an unknown one raises."""
    keys = catalog.select("path", F.explode(F.array_distinct(F.array("path", F.concat(F.lit(prefix), "path")))).alias("input"))
    rows = requests.join(keys.groupBy("input").agg(F.min("path").alias("path")), "input", "left")
    known = F.assert_true(F.col("path").isNotNull(), F.concat(F.lit("no such file: "), F.coalesce("input", F.lit("null"))))
    return rows.where(known.isNull())


def missing(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    return requests.select(F.col("input").alias("path")).distinct().join(catalog.select("path"), "path", "left_anti")


def needed_index(recipe: DataFrame, asked: DataFrame, placed: DataFrame) -> DataFrame:
    """(fp, node) of the chunks of asked files only."""
    fps = recipe.join(asked.select("path").distinct(), "path", "left_semi").select("fp").distinct()
    return placed.select("fp", "node").join(fps, "fp", "left_semi")


def reassembled(recipe: DataFrame, store: DataFrame) -> DataFrame:
    """(path, content): every file's chunks, from store(fp, data), in order; a chunk that is missing raises."""
    rows = recipe.join(store.select("fp", "data"), "fp", "left")
    there = F.assert_true(F.col("data").isNotNull(), F.concat(F.lit("missing chunk "), "fp"))
    rows = rows.where(there.isNull())
    hexed = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("h")))), lambda x: x["h"])
    return rows.groupBy("path").agg(F.unhex(F.array_join(hexed, "")).alias("content"))


def scenarios(spark, low: float = 0.5, high: float = 0.95, step: float = 0.05) -> DataFrame:
    """(at, kind, ratio): edge-all, cloud-full, and hybrids from high to low."""
    n = round((high - low) / step) + 1
    hybrid = spark.range(n).select((F.col("id") + 3).alias("at"), F.lit("hybrid").alias("kind"), F.round(F.lit(high) - F.col("id") * step, 2).alias("ratio"))
    fixed = spark.createDataFrame([(1, "edge-all", 1.0), (2, "cloud-full", 0.0)], "at long, kind string, ratio double")
    return fixed.unionByName(hybrid)


def runs_of(requests: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every request(at, input) in every scenario(at, kind, ratio): (id, scenario, kind, ratio, input, output), scenario after scenario.

    Scenarios are a handful of settings, so this product grows with the requests alone.
    """
    n = requests.count()
    each = F.broadcast(scenarios.select(F.col("at").alias("scenario"), "kind", "ratio"))
    name = F.element_at(F.split("input", "/"), -1)
    output = F.concat(F.lit("r"), F.lpad(F.round(F.col("ratio") * 100).cast("int").cast("string"), 3, "0"), F.lit("/"), F.lpad(F.col("at").cast("string"), 6, "0"), F.lit("-"), name)
    rows = requests.join(each, F.lit(True))
    return rows.select(((F.col("scenario") - 1) * n + F.col("at")).alias("id"), "scenario", "kind", "ratio", "input", output.alias("output"))


#: Phases of a restore as they are measured, and their names in the report.
PHASES = {"setup": "setup", "recipe_scan": "recipe_scan", "window_prepare": "window_prepare", "edge_fetch": "edge_fetch", "cloud_fallback_fetch": "cloud_fetch", "output_write": "output_write"}
_SIDE = ["bytes", "chunks_requested", "chunks_found", "batches", "rpc_seconds", "transfer_seconds"]


def export_rows(stats: DataFrame) -> DataFrame:
    """The restore report: 42 columns for each restored file, times and ratios to six decimals.

    stats: id, input_path, output_path, ratio, exit_code, runtime_seconds, bytes, chunks, duration_seconds,
    cloud_full_download, phases map<string,double>, nodes array<struct<is_cloud, bytes, chunks_requested,
    chunks_found, batches, rpc_seconds, transfer_seconds>>, stats_snapshot, stdout_tail, stderr_tail.
    A failed run has zeros for its figures.
    """
    ok = F.col("exit_code") == 0
    mib = lambda x: x.cast("double") / 1048576.0
    seconds = {p: F.when(ok, F.coalesce(F.try_element_at("phases", F.lit(p)), F.lit(0.0))).otherwise(0.0) for p in PHASES}
    total = F.aggregate(F.map_values("phases"), F.lit(0.0), lambda a, x: a + x)
    total = F.when(ok, F.coalesce(total, F.lit(0.0))).otherwise(0.0)
    duration = F.when(ok, F.coalesce("duration_seconds", F.lit(0.0))).otherwise(0.0)
    latency = F.when(total > 0, total).otherwise(duration)
    path = seconds["edge_fetch"] + seconds["cloud_fallback_fetch"] + seconds["output_write"]
    size, chunks = (F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("bytes", "chunks"))

    def side(cloud: bool, c: str) -> Column:
        zero = F.lit(0.0) if c.endswith("seconds") else F.lit(0).cast("long")
        mine = F.aggregate(F.filter("nodes", lambda x: x["is_cloud"] == F.lit(cloud)), zero, lambda a, x: a + x[c])
        return F.when(ok, F.coalesce(mine, zero)).otherwise(zero)

    sides = {("cloud" if k else "edge", c): side(k, c) for k in (False, True) for c in _SIDE}
    both = sides["edge", "bytes"] + sides["cloud", "bytes"]
    r6 = lambda x, name: F.round(x, 6).alias(name)
    out = [
        "id", F.element_at(F.split("input_path", "/"), -1).alias("file_name"), F.col("output_path").alias("experiment_output_path"),
        F.round(F.col("ratio") * 100).cast("int").alias("edge_ratio"), "exit_code", "runtime_seconds",
        r6(latency, "end_to_end_latency_seconds"), r6(F.when(path > 0, path).otherwise(duration), "data_path_latency_seconds"),
        r6(F.when(latency > 0, mib(size) / latency).otherwise(0.0), "throughput_mb_s"),
        size.alias("file_size_bytes"), r6(mib(size), "file_size_mb"), chunks.alias("chunk_count"),
        F.when(ok, F.coalesce("cloud_full_download", F.lit(False))).otherwise(False).alias("cloud_full_download"),
    ]
    out += [r6(x, f"{k}_{c}") if c.endswith("seconds") else x.alias(f"{k}_{c}") for (k, c), x in sides.items()]
    out += [r6(F.when(both > 0, sides[k, "bytes"] / both).otherwise(0.0), f"{k}_byte_ratio") for k in ("edge", "cloud")]
    for p, name in PHASES.items():
        out += [r6(seconds[p], f"phase_{name}_seconds"), r6(F.when(total > 0, seconds[p] * 100.0 / total).otherwise(0.0), f"phase_{name}_pct")]
    return stats.select(*out, "stats_snapshot", "stdout_tail", "stderr_tail")
