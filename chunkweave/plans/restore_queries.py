"""Restore and report queries, each with its SQL oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.operators import catalog, reports, restore, workload
from chunkweave.plans.corpus import BATCH, FNV, NODES, WINDOW, Corpus, r6, registry, sql

QUERIES, ORACLE_SQL, query = registry()
_POLICY = "d chunks firsts placed policy"
_FETCH = "d chunks firsts placed wdist fetched"
_COVER = "d chunks firsts placed cover classed"


def fetches(c: Corpus) -> DataFrame:
    return restore.edge_fetches(c.chunks, c.index, WINDOW, BATCH)


def decided(c: Corpus, threshold: int = 2) -> DataFrame:
    return restore.policy(c.chunks, c.index, NODES, threshold)


@query("s089_recipe_index_join", sql("d chunks firsts placed", "SELECT c.path, c.seq, p.node FROM chunks c JOIN (SELECT fp, node FROM placed) p USING (fp)"))
def _(c: Corpus) -> DataFrame:
    return c.chunks.join(c.index, "fp", "left").select("path", "seq", "node")


@query("s091_request_join", sql("d requests", "SELECT req_id, input, replace(input, '/in/', '') AS path FROM (SELECT req_id, CASE WHEN req_id % 2 = 0 THEN '/in/' || input ELSE input END AS input FROM requests)"))
def _(c: Corpus) -> DataFrame:
    asked = c.requests.select("req_id", F.when(F.col("req_id") % 2 == 0, F.concat(F.lit("/in/"), "input")).otherwise(F.col("input")).alias("input"))
    return restore.requested(c.sizes, asked, "/in/").select("req_id", "input", "path")


@query("s091b_missing_files", sql("d requests", "SELECT DISTINCT input || '.gone' AS path FROM requests WHERE req_id % 3 = 0"))
def _(c: Corpus) -> DataFrame:
    asked = c.requests.select(F.when(F.col("req_id") % 3 == 0, F.concat("input", F.lit(".gone"))).otherwise(F.col("input")).alias("input"))
    return restore.missing(asked, c.sizes)


@query("s118_restore_windows", sql("d chunks", f"SELECT path, seq // {WINDOW} AS \"window\", count(*) AS chunks FROM chunks GROUP BY ALL"))
def _(c: Corpus) -> DataFrame:
    return restore.windows(c.chunks, WINDOW).groupBy("path", "window").agg(F.count("*").alias("chunks"))


@query("s125_window_distinct", sql("d chunks wdist", "SELECT path, \"window\", fp, first_seq, uses, length FROM wdist"))
def _(c: Corpus) -> DataFrame:
    return restore.window_distinct(c.chunks, WINDOW)


@query("s129_restore_policy", sql(_POLICY, "SELECT path, chunks, bytes, non_edge, non_edge >= 2 AS cloud_full FROM policy"))
def _(c: Corpus) -> DataFrame:
    return decided(c)


@query("s130_edge_fetches", sql(_FETCH, "SELECT path, \"window\", node, chunks, bytes, batches FROM fetched"))
def _(c: Corpus) -> DataFrame:
    return fetches(c)


@query("s131_cloud_fetches", sql("d", "SELECT path, n * 1000 AS bytes, CAST(ceil(n * 1000 / 2097152.0) AS BIGINT) AS batches FROM d"))
def _(c: Corpus) -> DataFrame:
    return restore.cloud_fetches(c.sizes.select("path", (F.col("raw_size") * 1000).alias("bytes")))


_STATS = """, f AS (SELECT path, CAST(sum(batches) AS BIGINT) AS b, CAST(sum(bytes) AS BIGINT) AS n, count(DISTINCT node) AS k FROM fetched GROUP BY path),
rs AS (SELECT p.path, chunks, bytes, non_edge, non_edge >= 2 AS cloud_full, CASE WHEN non_edge >= 2 THEN CAST(ceil(bytes / 2097152.0) AS BIGINT) ELSE b END AS batches, CASE WHEN non_edge >= 2 THEN bytes ELSE n END AS fetched_bytes, CASE WHEN non_edge >= 2 THEN 1 ELSE k END AS nodes FROM policy p JOIN f USING (path))
"""


@query("s097_restore_file_stats", sql(_POLICY + " wdist fetched", _STATS + "SELECT * FROM rs"))
def _(c: Corpus) -> DataFrame:
    return restore.file_stats(decided(c), fetches(c))


@query("s098_restore_overall", sql(_POLICY + " wdist fetched", _STATS + "SELECT count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(batches) AS BIGINT) AS batches, count(*) FILTER (cloud_full) AS cloud_full_files, round(sum(chunks) / count(*), 6) AS avg_chunks, round(sum(bytes) / count(*), 6) AS avg_bytes, round(sum(batches) / count(*), 6) AS avg_batches FROM rs"))
def _(c: Corpus) -> DataFrame:
    o = restore.overall(restore.file_stats(decided(c), fetches(c)))
    return o.select(*(F.round(x, 6).alias(x) if t == "double" else x for x, t in o.dtypes))


def node_parts(c: Corpus) -> DataFrame:
    f = fetches(c)
    return f.select("node", F.when(F.col("node") > 0, F.concat(F.lit("edge"), F.col("node").cast("string"))).otherwise("cloud").alias("id"), "batches", F.col("chunks").alias("chunks_requested"), F.col("bytes").alias("bytes_returned"), (F.col("batches") * 0.002).alias("rpc_s"), (F.col("batches") * 0.001).alias("server_s"))


_NODE = "SELECT node, CASE WHEN node > 0 THEN 'edge' || node ELSE 'cloud' END AS id, CAST(sum(batches) AS BIGINT) AS batches, CAST(sum(chunks) AS BIGINT) AS chunks_requested, CAST(sum(bytes) AS BIGINT) AS bytes_returned, sum(batches) * 0.002 AS rpc_s FROM fetched GROUP BY node"


@query("s099_node_stats_merge", sql(_FETCH, f"SELECT node, id, batches, chunks_requested, bytes_returned, round(CAST(rpc_s AS DOUBLE), 6) AS rpc_s FROM ({_NODE})"))
def _(c: Corpus) -> DataFrame:
    return restore.merged_node_stats(node_parts(c)).select("node", "id", "batches", "chunks_requested", "bytes_returned", *r6("rpc_s"))


@query("s100_node_stats", sql(_FETCH, f"SELECT node, id, round(chunks_requested / batches, 6) AS avg_chunks, round(bytes_returned / batches, 6) AS avg_bytes, round(rpc_s / batches, 6) AS avg_rpc_s, round(CAST(50 AS DOUBLE), 6) AS server_pct, round(bytes_returned / 1048576.0 / rpc_s, 6) AS mib_s FROM ({_NODE})"))
def _(c: Corpus) -> DataFrame:
    return restore.node_stats(restore.merged_node_stats(node_parts(c))).select("node", "id", *r6("avg_chunks", "avg_bytes", "avg_rpc_s", "server_pct", "mib_s"))


@query("s101_edge_and_cloud_totals", sql(_FETCH, "SELECT CASE WHEN node = 0 THEN 'cloud' ELSE 'edge' END AS side, CAST(sum(batches) AS BIGINT) AS batches, CAST(sum(chunks) AS BIGINT) AS chunks_requested, CAST(sum(bytes) AS BIGINT) AS bytes_returned FROM fetched GROUP BY 1"))
def _(c: Corpus) -> DataFrame:
    return reports.group_totals(node_parts(c)).select("side", "batches", "chunks_requested", "bytes_returned")


@query("s102_phase_breakdown", """WITH r AS (SELECT event_id AS run, value + 1.0 AS total, value * 0.5 AS a, value * 0.25 AS b, value * 0.125 AS z FROM events WHERE value > 0),
x AS (SELECT run, total, 1 AS g, 'plan' AS phase, a AS s FROM r UNION ALL SELECT run, total, 2, 'fetch', b FROM r UNION ALL SELECT run, total, 3, 'audit', z FROM r UNION ALL SELECT run, total, 4, 'other', total - a - b - z FROM r WHERE total - a - b - z > 0.001)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY g) AS "at", phase, round(s, 10) AS seconds, round(s / total * 100, 10) AS pct FROM x""")
def _(c: Corpus) -> DataFrame:
    v = F.col("value")
    runs = c.table("events").where("value > 0").select(F.col("event_id").alias("run"), (v + 1.0).alias("total_s"), F.create_map(F.lit("audit"), v * 0.125, F.lit("fetch"), v * 0.25, F.lit("plan"), v * 0.5).alias("phases"))
    return reports.phase_breakdown(runs, ["plan", "fetch", "write"]).select("run", "at", "phase", *(F.round(x, 10).alias(x) for x in ("seconds", "pct")))


@query("s103_hybrid_elapsed_split", "SELECT event_id, round(value * CASE WHEN user_id > 0 THEN user_id / (user_id + 5.0) ELSE 0 END, 10) AS edge_s, round(value * (1 - CASE WHEN user_id > 0 THEN user_id / (user_id + 5.0) ELSE 0 END), 10) AS cloud_s FROM events")
def _(c: Corpus) -> DataFrame:
    e, k = restore.elapsed_split(F.col("value"), F.col("user_id"), F.lit(5), F.lit(1), F.lit(1))
    return c.table("events").select("event_id", F.round(e, 10).alias("edge_s"), F.round(k, 10).alias("cloud_s"))


@query("s104_task_counters", "SELECT user_id AS node, event_type AS task, count(*) AS requests, CAST(sum(event_id) AS BIGINT) AS bytes, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    e = c.table("events").select(F.col("user_id").alias("node"), F.col("event_type").alias("task"), F.col("event_id").alias("bytes"), F.col("value").alias("seconds"))
    return reports.task_counters(e).withColumn("seconds", F.round("seconds", 4))


def cover(c: Corpus) -> DataFrame:
    return reports.coverage(c.chunks, c.index)


@query("s105_edge_coverage", sql(_COVER, "SELECT path, total_chunks, edge_chunks, total_bytes, edge_bytes, round(edge_ratio, 6) AS edge_ratio, class FROM classed"))
def _(c: Corpus) -> DataFrame:
    return cover(c).withColumn("edge_ratio", F.round("edge_ratio", 6))


@query("s106_coverage_summary", sql(_COVER, "SELECT class, count(*) AS files, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(edge_bytes) AS BIGINT) AS edge_bytes FROM classed GROUP BY class"))
def _(c: Corpus) -> DataFrame:
    return reports.coverage_summary(cover(c))


@query("s106_node_distribution", sql(_COVER, ", t AS (SELECT class, node, count(*) AS chunks, CAST(sum(c.length) AS BIGINT) AS bytes FROM chunks c JOIN (SELECT fp, node FROM placed WHERE node > 0) USING (fp) JOIN (SELECT path, class FROM classed WHERE class <> 'none') USING (path) GROUP BY ALL) SELECT *, round(bytes / sum(bytes) OVER (PARTITION BY class), 6) AS share FROM t"))
def _(c: Corpus) -> DataFrame:
    return reports.node_distribution(c.chunks, c.index, cover(c)).withColumn("share", F.round("share", 6))


@query("s121_top_partial_files", sql(_COVER, "SELECT path, edge_bytes, row_number() OVER (ORDER BY edge_ratio DESC, edge_bytes DESC, path) AS rank FROM classed WHERE class = 'partial' ORDER BY rank LIMIT 20"))
def _(c: Corpus) -> DataFrame:
    return reports.top_partial(cover(c), 20).select("path", "edge_bytes", "rank")


def runs(c: Corpus) -> DataFrame:
    """Requests with a modelled time and heat."""
    f = c.counts.select(F.col("path").alias("input"), "heat", F.col("raw_size").alias("bytes"), (0.05 + F.col("raw_size") * 8.0 / 1e8).alias("duration_s"), (F.col("doc_id") % 5 == 0).alias("cloud_full"))
    return c.requests.join(f, "input").withColumnRenamed("input", "path")


_RUNS = sql("d files heat requests", ", runs AS (SELECT r.req_id, r.arrival_s, r.input AS path, h.heat, h.raw_size AS bytes, 0.05 + h.raw_size * 8.0 / 1e8 AS duration_s, h.doc_id % 5 = 0 AS cloud_full FROM requests r JOIN heat h ON h.path = r.input)\n")


@query("s107_replay_summary", _RUNS + "SELECT count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(duration_s), 6) AS mean_s, round(quantile_cont(duration_s, 0.5), 6) AS p50_s, round(quantile_cont(duration_s, 0.95), 6) AS p95_s, round(avg(gap), 6) AS mean_gap_s FROM (SELECT *, greatest(arrival_s - coalesce(lag(arrival_s) OVER (ORDER BY arrival_s), 0), 0) AS gap FROM runs)")
def _(c: Corpus) -> DataFrame:
    return reports.replay_summary(runs(c)).select("requests", "bytes", *r6("mean_s", "p50_s", "p95_s", "mean_gap_s"))


@query("s108_hot_set", _RUNS + ", f AS (SELECT path, max(heat) AS heat, avg(duration_s) AS s, bool_or(cloud_full) AS cf FROM runs GROUP BY path ORDER BY heat DESC, path LIMIT 10) SELECT count(*) AS files, count(*) FILTER (cf) AS cloud_files, round(coalesce(sum(heat) FILTER (cf), 0) / sum(heat), 6) AS cloud_heat_share, round(sum(heat * s) / sum(heat), 6) AS weighted_s FROM f")
def _(c: Corpus) -> DataFrame:
    return reports.hot_set(runs(c), 10).select("files", "cloud_files", *r6("cloud_heat_share", "weighted_s"))


@query("s109_sla_rollup", "WITH e AS (SELECT DISTINCT user_id % 3 AS protect, 10 AS k, event_type AS input, user_id % 4 AS cap FROM events) SELECT CAST(protect AS BIGINT) AS protect, k, count(*) AS cells, round(avg(cap), 6) AS avg_cloud_files, max(cap) AS max_cloud_files, round(avg(cap / 4.0), 6) AS avg_share, round(max(cap / 4.0), 6) AS max_share FROM e GROUP BY protect, k")
def _(c: Corpus) -> DataFrame:
    e = c.table("events").select((F.col("user_id") % 3).alias("protect"), F.lit(10).alias("k"), F.col("event_type").alias("input"), (F.col("user_id") % 4).alias("cap"))
    cells = e.withColumn("cloud_files", F.col("cap")).withColumn("cloud_heat_share", F.col("cap") / 4.0)
    return reports.sla_rollup(cells).select("protect", "k", "cells", "max_cloud_files", *r6("avg_cloud_files", "avg_share", "max_share"))


@query("s110_null_skipping_averages", "SELECT event_type AS run, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT event_type, avg(value) AS a, avg(value) FILTER (user_id > 5) AS b FROM events GROUP BY event_type UNION ALL SELECT 'average', avg(a), avg(b) FROM (SELECT avg(value) AS a, avg(value) FILTER (user_id > 5) AS b FROM events GROUP BY event_type))")
def _(c: Corpus) -> DataFrame:
    t = c.table("events").groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("a"), F.avg(F.when(F.col("user_id") > 5, F.col("value"))).alias("b"))
    return reports.averages(t, ["a", "b"]).select("run", *r6("a", "b"))


@query("s032_union_of_keys", "SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS kind FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 2 = 1")
def _(c: Corpus) -> DataFrame:
    e = c.table("events")
    return reports.union_of_keys([e.where("event_id % 2 = 0").select("event_id", "user_id"), e.where("event_id % 2 = 1").select("event_id", F.col("event_type").alias("kind"))])


@query("s113_run_status", "WITH c AS (SELECT user_id AS run, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status FROM events), t AS (SELECT run, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM c GROUP BY run) SELECT *, CASE WHEN failed > 0 AND ok > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' WHEN ok > 0 THEN 'ok' ELSE 'skipped' END AS overall FROM t")
def _(c: Corpus) -> DataFrame:
    t = F.col("event_type")
    return reports.status_rollup(c.table("events").select(F.col("user_id").alias("run"), F.when(t == "error", "failed").when(t == "view", "skipped").otherwise("ok").alias("status")))


@query("s114_failure_summary", "WITH l AS (SELECT user_id AS run, event_id AS pos, event_type || ' at ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos DESC) AS n FROM l WHERE b <= 40 AND contains(line, 'error')) SELECT run, string_agg(line, ' | ' ORDER BY pos) AS summary FROM h WHERE n <= 5 GROUP BY run")
def _(c: Corpus) -> DataFrame:
    lines = c.table("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.concat("event_type", F.lit(" at "), F.col("event_id").cast("string")).alias("line"))
    return reports.failure_summary(lines)


@query("s126_sorted_unique", sql("d chunks", "SELECT path, string_agg(DISTINCT fp, ',' ORDER BY fp) AS fps FROM chunks GROUP BY path"))
def _(c: Corpus) -> DataFrame:
    return c.chunks.groupBy("path").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("fp"))), ",").alias("fps"))


_HOT = "SELECT file_id FROM heat ORDER BY heat DESC, file_id LIMIT (SELECT greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) FROM heat)"


def hot_chunks(c: Corpus) -> DataFrame:
    """Chunks of the hottest tenth of the files."""
    return c.numbered_chunks.join(catalog.protected(c.heat, 0.1).select("path"), "path", "left_semi")


@query("s127_new_chunks_of_files", sql("d files heat chunks", "SELECT path, count(DISTINCT fp) AS fresh FROM chunks WHERE fp NOT IN (SELECT fp FROM chunks JOIN files USING (path) WHERE file_id IN (" + _HOT + ")) GROUP BY path"))
def _(c: Corpus) -> DataFrame:
    stored = hot_chunks(c).select("fp").distinct()
    return c.chunks.join(stored, "fp", "left_anti").groupBy("path").agg(F.countDistinct("fp").alias("fresh"))


@query("s128_bytes_of_a_selection", sql("d files heat chunks", "SELECT CAST(sum(length) AS BIGINT) AS bytes FROM (SELECT DISTINCT fp, length FROM chunks JOIN files USING (path) WHERE file_id IN (" + _HOT + "))"))
def _(c: Corpus) -> DataFrame:
    return hot_chunks(c).select("fp", "length").distinct().agg(F.sum("length").alias("bytes"))


@query("s132_hybrid_experiment", sql("d chunks firsts placed", f""", e AS (SELECT fp, node BETWEEN 1 AND {NODES} AND {FNV} <= CAST({int(0.8 * float(2**64 - 1))} AS UBIGINT) AS e FROM placed)
SELECT c.path, count(*) FILTER (e) AS edge_chunks, CAST(coalesce(sum(c.length) FILTER (e), 0) AS BIGINT) AS edge_bytes, count(*) FILTER (NOT e) AS cloud_chunks, CAST(coalesce(sum(c.length) FILTER (NOT e), 0) AS BIGINT) AS cloud_bytes FROM chunks c JOIN e USING (fp) GROUP BY c.path"""))
def _(c: Corpus) -> DataFrame:
    return restore.experiment(c.chunks, c.index, NODES, "hybrid", 0.8)


@query("s132_edge_all_experiment", sql("d chunks firsts placed", "SELECT c.path, count(*) FILTER (node > 0) AS edge_chunks, CAST(coalesce(sum(c.length) FILTER (node > 0), 0) AS BIGINT) AS edge_bytes, count(*) FILTER (node = 0) AS cloud_chunks, CAST(coalesce(sum(c.length) FILTER (node = 0), 0) AS BIGINT) AS cloud_bytes FROM chunks c JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY c.path"))
def _(c: Corpus) -> DataFrame:
    return restore.experiment(c.chunks, c.index, NODES, "edge-all")


@query("s133_requested_index", sql("d chunks firsts placed requests", "SELECT fp, node FROM placed WHERE fp IN (SELECT fp FROM chunks WHERE path IN (SELECT input FROM requests))"))
def _(c: Corpus) -> DataFrame:
    return restore.needed_index(c.chunks, c.requests.select(F.col("input").alias("path")), c.placed)


@query("s134_byte_exact_restore", sql("d", "SELECT path, sha1(encode(text)) AS sha1, n AS bytes FROM d WHERE n > 0"))
def _(c: Corpus) -> DataFrame:
    from chunkweave.plans.corpus import CHUNK

    keyed = c.contents.select("path", "content")
    n = F.octet_length("content")
    pieces = keyed.select("path", F.explode(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda i: F.substring("content", i * CHUNK + 1, F.lit(CHUNK))))).alias("data"))
    store = pieces.select(F.sha1("data").alias("fp"), "data").dropDuplicates(["fp"])
    out = restore.reassembled(c.chunks.select("path", "seq", "fp"), store)
    return out.select("path", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("bytes"))


@query("s136_scenarios", "SELECT CAST(pos AS BIGINT) AS \"at\", kind, round(CAST(ratio AS DOUBLE), 2) AS ratio FROM (SELECT 1 AS pos, 'edge-all' AS kind, 1.0 AS ratio UNION ALL SELECT 2, 'cloud-full', 0.0 UNION ALL SELECT i + 3, 'hybrid', 0.95 - i * 0.05 FROM range(0, 10) t(i))")
def _(c: Corpus) -> DataFrame:
    return restore.scenarios(c.spark)


_U = "((CAST('0x' || substr(sha1('{seed}|' || {key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("s172_poisson_arrivals", "SELECT event_id AS req_id, round(sum(-ln(1.0 - " + _U.format(seed=7, key="event_id") + ") / 2.0) OVER (ORDER BY event_id), 6) AS arrival_s FROM events")
def _(c: Corpus) -> DataFrame:
    return workload.poisson_arrivals(c.table("events").select(F.col("event_id").alias("req_id")), 2.0, 7).select("req_id", "arrival_s")


@query("s173_paced_replay", sql("d requests", "SELECT req_id, round(greatest(arrival_s - coalesce(lag(arrival_s) OVER (ORDER BY arrival_s, req_id), 0), 0) / 10, 7) AS wait_s FROM requests"))
def _(c: Corpus) -> DataFrame:
    return workload.paced(c.requests, 10.0).select("req_id", F.round("wait_s", 7).alias("wait_s"))


@query("s174_sampling_with_replacement", sql("d files heat", ", w AS (SELECT path, heat, sum(heat) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS hi FROM heat), s AS (SELECT i AS req_id, " + _U.format(seed=7, key="i") + " * (SELECT max(hi) FROM w) AS u FROM range(1, 201) t(i)) SELECT req_id, path FROM s JOIN w ON u >= hi - heat AND u < hi"))
def _(c: Corpus) -> DataFrame:
    return workload.sample_with_replacement(c.heat, 200, 7)


@query("s174_sampling_without_replacement", sql("d files heat", ", k AS (SELECT path, ln(" + _U.format(seed=7, key="path") + ") / heat AS k FROM heat) SELECT row_number() OVER (ORDER BY k DESC, path) AS rank, path FROM k ORDER BY rank LIMIT 30"))
def _(c: Corpus) -> DataFrame:
    return workload.sample_without_replacement(c.heat, 30, 7)


@query("s111_request_shares", sql("d chunks requests", "SELECT r.path, round(r.n / (SELECT count(*) FROM requests), 6) AS lambda, c.chunks FROM (SELECT input AS path, count(*) AS n FROM requests GROUP BY 1) r JOIN (SELECT path, count(*) AS chunks FROM chunks GROUP BY 1) c USING (path)"))
def _(c: Corpus) -> DataFrame:
    from chunkweave.operators.placement import hot_input

    files, _ = hot_input(c.chunks, c.requests.select(F.col("input").alias("path")), 0.2)
    return files.select("path", F.round("lambda", 6).alias("lambda"), F.size("chunks").cast("long").alias("chunks"))


@query("s124_stable_sets", sql("d chunks", """, f AS (SELECT path, fp, min(seq) AS s, min(seq) FILTER (seq % 2 = 0) AS e, count(*) FILTER (seq % 2 = 1) AS o FROM chunks GROUP BY ALL)
SELECT path, sha1(string_agg(fp, ',' ORDER BY s)) AS both, coalesce(string_agg(fp, ',' ORDER BY e) FILTER (e IS NOT NULL AND o > 0), '') AS common FROM f GROUP BY path"""))
def _(c: Corpus) -> DataFrame:
    """Union and intersection of a file's even and odd chunks, in the order in which they first come."""
    order = F.array_sort(F.collect_list(F.struct("seq", "fp")))
    rows = c.chunks.groupBy("path").agg(order.alias("l"))
    side = lambda odd: F.transform(F.filter("l", lambda x: x["seq"] % 2 == odd), lambda x: x["fp"])
    every = F.transform("l", lambda x: x["fp"])
    return rows.select("path", F.sha1(F.array_join(F.array_union(every, every), ",")).alias("both"), F.array_join(F.array_intersect(side(0), side(1)), ",").alias("common"))


@query("s005_catalog_files", sql("d files heat chunks counts", "SELECT file_id, path, raw_size, n_chunks FROM counts"))
def _(c: Corpus) -> DataFrame:
    return catalog.with_density(c.counts).select("file_id", "path", "raw_size", "n_chunks")
