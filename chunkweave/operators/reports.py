"""Reports over placements, restores and experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.cost import safe_ratio
from chunkweave.staging import numbered, preceded


def coverage(chunks: DataFrame, placement: DataFrame) -> DataFrame:
    """(path, total_chunks, edge_chunks, total_bytes, edge_bytes, edge_ratio, class): places whose chunk is on an edge; full, partial or none."""
    rows = chunks.join(placement.select("fp", "node"), "fp", "left")
    edge = F.col("node") > 0
    t = rows.groupBy("path").agg(F.count("*").alias("total_chunks"), F.count(F.when(edge, 1)).alias("edge_chunks"), F.sum("length").alias("total_bytes"), F.coalesce(F.sum(F.when(edge, F.col("length"))), F.lit(0)).alias("edge_bytes"))
    full = (F.col("total_bytes") > 0) & (F.col("edge_bytes") == F.col("total_bytes"))
    return t.withColumn("edge_ratio", safe_ratio(F.col("edge_bytes"), F.col("total_bytes"))).withColumn("class", F.when(full, "full").when(F.col("edge_bytes") > 0, "partial").otherwise("none"))


def coverage_summary(cover: DataFrame) -> DataFrame:
    return cover.groupBy("class").agg(F.count("*").alias("files"), F.sum("total_bytes").alias("total_bytes"), F.sum("edge_bytes").alias("edge_bytes"))


def node_distribution(chunks: DataFrame, placement: DataFrame, cover: DataFrame) -> DataFrame:
    """(class, node, chunks, bytes, share of the class's edge bytes) for full and partial files."""
    rows = chunks.join(placement.where("node > 0").select("fp", "node"), "fp").join(cover.where("class <> 'none'").select("path", "class"), "path")
    t = rows.groupBy("class", "node").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
    return t.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy("class")))


def top_partial(cover: DataFrame, k: int) -> DataFrame:
    """The k partial files with most on the edge: by ratio, edge bytes, then path."""
    ranked = cover.where("class = 'partial'").orderBy(F.desc("edge_ratio"), F.desc("edge_bytes"), "path").limit(k)
    return numbered(ranked, [F.desc("edge_ratio"), F.desc("edge_bytes"), F.asc("path")], "rank")


def replay_summary(runs: DataFrame) -> DataFrame:
    """One row over runs(arrival_s, duration_s, bytes): totals, mean, median and p95 (linear), mean time between arrivals.

    Arrivals are compared with the ones before, and durations ranked, by ranges: no task has all runs.
    """
    gaps = preceded(runs.select("arrival_s", "duration_s", "bytes"), ["arrival_s", "duration_s"], F.col("arrival_s"), "_last", 0.0)
    gap = F.greatest(F.col("arrival_s") - F.col("_last"), F.lit(0.0))
    t = gaps.agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.avg("duration_s").alias("mean_s"), F.avg(gap).alias("mean_gap_s"))
    ranked = numbered(runs.where("duration_s IS NOT NULL").select("duration_s"), ["duration_s"], "_n", 0)
    n = ranked.count()
    value = lambda k: F.max(F.when(F.col("_n") == k, F.col("duration_s")))

    def at(p: float) -> Column:
        low, share = divmod(p * max(n - 1, 0), 1.0)
        return value(low) + (F.coalesce(value(low + 1), value(low)) - value(low)) * share

    two = ranked.agg(at(0.5).alias("p50_s"), at(0.95).alias("p95_s"))
    return t.join(two, F.lit(True)).select("requests", "bytes", "mean_s", "p50_s", "p95_s", "mean_gap_s")  # one row each


def hot_set(requests: DataFrame, top: int) -> DataFrame:
    """One row over requests(path, heat, duration_s, cloud_full): of the `top` hottest restored files the cloud's count and heat share and the heat-weighted mean time."""
    files = requests.groupBy("path").agg(F.max("heat").alias("heat"), F.avg("duration_s").alias("duration_s"), F.max("cloud_full").alias("cloud_full"))
    hot = files.orderBy(F.desc("heat"), "path").limit(top)
    cloud_heat = F.coalesce(F.sum(F.when(F.col("cloud_full"), F.col("heat"))), F.lit(0.0))
    return hot.agg(F.count("*").alias("files"), F.count(F.when(F.col("cloud_full"), 1)).alias("cloud_files"), safe_ratio(cloud_heat, F.sum("heat")).alias("cloud_heat_share"), safe_ratio(F.sum(F.col("heat") * F.col("duration_s")), F.sum("heat")).alias("weighted_s"))


def sla_rollup(cells: DataFrame) -> DataFrame:
    """Average and largest of cells(protect, k, input, cap, cloud_files, cloud_heat_share) over inputs and capacities, equal cells counted once."""
    one = cells.dropDuplicates(["protect", "k", "input", "cap"])
    return one.groupBy("protect", "k").agg(F.count("*").alias("cells"), F.avg("cloud_files").alias("avg_cloud_files"), F.max("cloud_files").alias("max_cloud_files"), F.avg("cloud_heat_share").alias("avg_share"), F.max("cloud_heat_share").alias("max_share"))


def phase_breakdown(runs: DataFrame, order: list[str]) -> DataFrame:
    """(run, at, phase, seconds, pct) of runs(run, total_s, phases map): known phases in order, others by name, `other` for what is left if over 1 ms."""
    rows = runs.select("run", "total_s", F.explode("phases").alias("phase", "seconds"))
    left = rows.groupBy("run", "total_s").agg(F.sum("seconds").alias("s")).where(F.col("total_s") - F.col("s") > 0.001)
    rows = rows.unionByName(left.select("run", "total_s", F.lit("other").alias("phase"), (F.col("total_s") - F.col("s")).alias("seconds")))
    known = F.array_position(F.array(*map(F.lit, order)), F.col("phase"))
    group = F.when(F.col("phase") == "other", F.lit(2)).when(known > 0, F.lit(0)).otherwise(F.lit(1))
    at = F.row_number().over(Window.partitionBy("run").orderBy(group, F.when(known > 0, known).otherwise(F.lit(0)), "phase")).cast("long")
    return rows.select("run", at.alias("at"), "phase", "seconds", (safe_ratio(F.col("seconds"), F.col("total_s")) * 100).alias("pct"))


def group_totals(nodes: DataFrame) -> DataFrame:
    """Counters of all edges and of the cloud (node 0, or an id `cloud`)."""
    cloud = (F.col("node") == 0) | (F.lower(F.coalesce("id", F.lit(""))) == "cloud")
    names = [c for c in nodes.columns if c not in ("node", "id")]
    return nodes.groupBy(F.when(cloud, "cloud").otherwise("edge").alias("side")).agg(*(F.sum(c).alias(c) for c in names))


def task_counters(events: DataFrame) -> DataFrame:
    """(node, task, requests, bytes, seconds) of events(node, task, bytes, seconds)."""
    return events.groupBy("node", "task").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))


def averages(table: DataFrame, names: list[str], label: str = "average") -> DataFrame:
    """table with a last row of averages that leave nulls out; other columns are null there, the first has the label."""
    first = table.columns[0]
    last = table.agg(*(F.avg(c).alias(c) for c in names)).withColumn(first, F.lit(label))
    rows = table.select(*(F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in table.columns))
    return rows.unionByName(last, allowMissingColumns=True)


def union_of_keys(tables: list[DataFrame]) -> DataFrame:
    """All rows with all columns, columns in the order in which they are first seen."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def status_rollup(cells: DataFrame) -> DataFrame:
    """(run, ok, failed, skipped, status): ok, partial, failed or skipped of cells(run, status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    t = cells.groupBy("run").agg(n("ok"), n("failed"), n("skipped"))
    status = F.when((F.col("failed") > 0) & (F.col("ok") > 0), "partial").when(F.col("failed") > 0, "failed").when(F.col("ok") > 0, "ok").otherwise("skipped")
    return t.withColumn("overall", status)


def failure_summary(lines: DataFrame, last: int = 40, words: str = "error|exception|failed|traceback|panic", most: int = 5) -> DataFrame:
    """(run, summary): of the last lines(run, at, line) those with a keyword, the last ones joined by ` | `."""
    late = lines.withColumn("back", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at")))).where(F.col("back") <= last)
    hits = late.where(F.lower("line").rlike(words)).withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at")))).where(F.col("n") <= most)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.trim(x["line"])), " | ")
    return hits.groupBy("run").agg(said.alias("summary"))


def gain_summary(gains: DataFrame) -> DataFrame:
    return gains.agg(F.avg("gain").alias("mean_gain"), F.max("gain").alias("max_gain"), F.min("gain").alias("min_gain"))


#: Metrics of a suite's run by the document and the section that hold them; fixed names of the report.
SUITE_METRICS = {
    "placement": {
        "summary": ["clustered_file_count", "unique_chunk_count", "total_theoretical_gain"],
        "protection": ["protected_target_count", "protected_selected_count", "stage1_selected_rows", "stage1_total_protected_heat"],
        "theory.gain_summary": ["mean_seconds", "max_seconds"],
    },
    "dedup": {"overall_average": ["total_original_bytes", "total_unique_bytes", "total_network_sent_bytes", "total_duration_seconds", "throughput_mb_s", "dedup_ratio"]},
    "restore": {"overall_average": ["file_count", "cloud_full_download_files", "total_bytes", "total_duration_seconds", "throughput_mb_s", "average_duration_seconds_per_file"]},
}


def suite_metrics(runs: DataFrame) -> DataFrame:
    """runs(run, placement, dedup, restore) of JSON texts as (run, 22 metrics as doubles); a metric that isn't there is null."""
    out = []
    for doc, sections in SUITE_METRICS.items():
        for section, names in sections.items():
            for name in names:
                label = f"gain_{name}" if section == "theory.gain_summary" else name
                label = label if label.startswith(f"{doc}_") else f"{doc}_{label}"
                out.append(F.get_json_object(doc, f"$.{section}.{name}").try_cast("double").alias(label))
    mapped = F.json_object_keys(F.get_json_object("placement", "$.hash2edge_node_id"))
    return runs.select("run", *out, F.coalesce(F.size(mapped), F.lit(0)).cast("double").alias("placement_mapped_hash_count"))
