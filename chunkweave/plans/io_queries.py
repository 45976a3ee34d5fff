"""Reader and writer queries: what a writer has written to the shared folder, a reader reads back."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.config import LinkModel
from chunkweave.functions import cost, naming
from chunkweave.operators import catalog, containers, dedup, placement, reports, restore
from chunkweave.plans.corpus import CHUNK, NODES, Corpus, r6, registry, sql
from chunkweave.sources import readers, writers
from chunkweave.staging import staging

QUERIES, ORACLE_SQL, query = registry()
_PLACED = "d chunks firsts placed"


def folder(c: Corpus, name: str) -> str:
    return f"{staging(c.spark)}/{name}-{uuid.uuid4().hex}"


def text(rows: DataFrame, path: str) -> str:
    """Rows with one string column as lines; with `bucket` as one document for each bucket."""
    out = rows.repartition("bucket").write.partitionBy("bucket") if "bucket" in rows.columns else rows.write
    out.text(path)
    return path


def json_maps(rows: DataFrame, key: str, value: Column, wrap: str | None = None) -> DataFrame:
    """(bucket, value): JSON maps of rows(bucket, key, ...), under the key `wrap` if there is one."""
    entries = F.map_from_entries(F.collect_list(F.struct(key, value)))
    doc = F.create_map(F.lit(wrap), entries) if wrap else entries
    return rows.groupBy("bucket").agg(F.to_json(doc).alias("value"))


def bucket(key: str = "fp") -> Column:
    return F.substring(F.sha1(key), 1, 2).alias("bucket")


# Hash traces.


@query("s007_hash_traces", sql("d chunks", "SELECT path, seq, fp, length FROM chunks"))
def _(c: Corpus) -> DataFrame:
    """Chunks as traces of one folder's share each, written out as the format has it, and read again."""

    def trace(x: pd.DataFrame) -> pd.DataFrame:
        files = [(p, g.sort_values("seq")) for p, g in x.groupby("path")]
        head = struct.pack("<IIQ", readers.FSL_MAGIC, readers.FSL_VERSION, len(files)) + b"/data".ljust(4096, b"\0")
        head += struct.pack("<QI", len(x), readers.FSL_VARIABLE) + b"\0" * 44 + struct.pack("<II", 1, 160) + b"\0" * 4096 + struct.pack("<QQQ", 0, 0, int(x["length"].sum()))
        body = []
        for path, g in files:
            name = f"/data/{path}".encode()
            body.append(struct.pack("<QQII", int(g["length"].sum()), 0, 0, 0) + b"\0" * 56 + struct.pack("<QII", len(g), len(name), 0) + name)
            body += [struct.pack("<I", n) + bytes.fromhex(f) + b"\0" for f, n in zip(g["fp"], g["length"], strict=True)]
        return pd.DataFrame([{"path": x["share"].iloc[0], "content": head + b"".join(body)}])

    share = F.concat(F.substring(F.sha1("path"), 1, 2), F.lit(".hash")).alias("share")
    rows = c.chunks.select(share, "path", "seq", "fp", "length").groupBy("share").applyInPandas(trace, "path string, content binary")
    return readers.traces(rows).select("path", "seq", "fp", "length")


@query("s008_trace_chunk_sizes", """SELECT event_id, CAST(CASE WHEN m = 1 THEN algo WHEN m = 2 AND algo IN (2, 3) AND bits BETWEEN 1 AND 30 THEN 1 << bits WHEN m = 2 AND low > 0 AND high >= low THEN (low + high) // 2 ELSE 8192 END AS BIGINT) AS chunk_bytes
FROM (SELECT event_id, event_id % 4 AS m, event_id % 5 AS algo, CAST(user_id % 40 AS BIGINT) AS bits, event_id % 3 * 1000 AS low, event_id % 7 * 700 AS high FROM events)""")
def _(c: Corpus) -> DataFrame:
    def run(batches):
        for b in batches:
            sizes = [readers.trace_chunk_bytes(k % 4, struct.pack("<I20xI8xII", k % 5, u % 40, k % 3 * 1000, k % 7 * 700)) for k, u in zip(b["event_id"].tolist(), b["user_id"].tolist(), strict=True)]
            yield pd.DataFrame({"event_id": b["event_id"], "chunk_bytes": sizes})

    return c.table("events").select("event_id", "user_id").mapInPandas(run, "event_id long, chunk_bytes long")


# Placements and indexes.


@query("s011_placement_json", sql(_PLACED, "SELECT fp, CASE WHEN node % 3 = 0 THEN 'edge' || node ELSE CAST(node AS VARCHAR) END AS node_ref FROM placed WHERE node > 0"))
def _(c: Corpus) -> DataFrame:
    """Documents with plain maps and with maps under their key; values as names, numbers and numbers in strings."""
    rows = c.index.where("node > 0").select("fp", "node", bucket())
    entry = lambda x: F.concat(F.lit('"'), x["fp"], F.when(x["node"] % 3 == 0, F.concat(F.lit('":"edge'), x["node"], F.lit('"'))).when(x["node"] % 3 == 1, F.concat(F.lit('":'), x["node"])).otherwise(F.concat(F.lit('":" '), x["node"], F.lit(' "'))))
    plain = F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list(F.struct("fp", "node")), entry), ","), F.lit(',"other":null,"":1}'))
    docs = rows.groupBy("bucket").agg(plain.alias("value"))
    docs = docs.select("bucket", F.when(F.col("bucket") < "80", F.col("value")).otherwise(F.concat(F.lit('{"hash2edge_node_id":'), "value", F.lit("}"))).alias("value"))
    return readers.placement_json(c.spark, text(docs, folder(c, "placement")))


@query("s012_placement_text", sql(_PLACED, "SELECT fp, 'edge' || node AS node_ref FROM placed"))
def _(c: Corpus) -> DataFrame:
    fp, node = F.col("fp"), F.concat(F.lit("edge"), F.col("node").cast("string"))
    line = F.when(F.col("node") % 2 == 0, F.concat(fp, F.lit(" "), node)).otherwise(F.concat(fp, F.lit(","), node, F.lit("  # by hand")))
    rows = c.index.select(line.alias("value")).union(c.index.select(F.concat(F.lit("# "), "fp")).union(c.index.select(F.lit("  "))))
    return readers.placement_text(c.spark, text(rows, folder(c, "placement")))


@query("s013_placement_folder", sql(_PLACED, "SELECT fp, CASE WHEN node > 5 THEN 'cloud' ELSE CAST(node AS VARCHAR) END AS node_ref FROM placed WHERE node > 0"))
def _(c: Corpus) -> DataFrame:
    """Of a fingerprint in two files the last one by name counts."""
    path, rows = folder(c, "placements"), c.index.where("node > 0")
    text(json_maps(rows.select("fp", "node", bucket()), "fp", F.col("node")), f"{path}/a.json")
    text(rows.where("node > 5").select(F.concat("fp", F.lit(" cloud")).alias("value")), f"{path}/b.txt")
    return readers.placement_folder(c.spark, path)


@query("s014_global_index", sql(_PLACED, "SELECT fp, node FROM placed"))
def _(c: Corpus) -> DataFrame:
    """A third of the index in each of the three forms; a file that isn't there is an empty index."""
    path, rows = folder(c, "index"), c.index.select("fp", "node", bucket())
    name = F.when(F.col("node") > 0, F.concat(F.lit("edge"), F.col("node").cast("string"))).otherwise("cloud")
    text(json_maps(rows.where("bucket < '50'"), "fp", F.col("node")), f"{path}/plain")
    text(json_maps(rows.where("bucket >= '50' AND bucket < 'a0'"), "fp", F.col("node"), "hash_to_node"), f"{path}/wrapped")
    text(json_maps(rows.where("bucket >= 'a0'"), "fp", name), f"{path}/named")
    out = readers.global_index(c.spark, f"{path}/missing")
    for form in ("plain", "wrapped", "named"):
        out = out.unionByName(readers.global_index(c.spark, f"{path}/{form}"))
    return out


@query("s024_global_index_writer", sql(_PLACED, "SELECT fp, node FROM placed"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "global")
    writers.index(c.index, path)
    return c.spark.read.parquet(path).select("fp", "node")


@query("s025_local_index_writer", sql(_PLACED, "SELECT fp, node, path || '/' || seq AS location FROM placed WHERE node > 0"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "local")
    writers.index(c.placed.where("node > 0").select("fp", "node", F.concat_ws("/", "path", F.col("seq").cast("string")).alias("location")), path)
    return c.spark.read.parquet(path).select("fp", "node", "location")


# Traces, settings, statistics.


@query("s016_arrival_trace", sql("d requests", "SELECT arrival_s, input, '/out/' || req_id AS output FROM requests"))
def _(c: Corpus) -> DataFrame:
    rows = c.requests.select(F.concat_ws("\t", F.col("arrival_s").cast("decimal(20,6)").cast("string"), "input", F.concat(F.lit("/out/"), F.col("req_id").cast("string"))).alias("value"))
    head = c.spark.range(1).select(F.lit("# arrival_sec\tinput_path\toutput_path").alias("value"))
    return readers.arrivals(c.spark, text(head.union(rows), folder(c, "arrivals")))


@query("s017_key_values", "SELECT n_nationkey, 'N' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'Q', 'a=b # ' || n_regionkey FROM nation")
def _(c: Corpus) -> DataFrame:
    """A file for each nation: comments, blank lines, quotes, and a key of which the last value counts."""
    body = F.concat(F.lit("# made\n\nN=first\n Q = 'a=b # "), F.col("n_regionkey").cast("string"), F.lit("'\nno value\nN=\""), "n_name", F.lit('"\n'))

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(n, k, v) for n, t in zip(b["n_nationkey"], b["value"], strict=True) for k, v in config.key_values(t).items()], columns=["n_nationkey", "key", "value"])

    return c.table("nation").select("n_nationkey", body.alias("value")).mapInPandas(run, "n_nationkey long, key string, value string")


@query("s018_yaml_settings", """SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS put_batch, n_regionkey % 2 = 0 AS replicate_to_cloud, 'edge1,' || n_name AS nodes, CAST(128 AS BIGINT) AS get_batch FROM nation""")
def _(c: Corpus) -> DataFrame:
    key, yes = F.col("n_nationkey").cast("string"), F.when(F.col("n_regionkey") % 2 == 0, "true").otherwise("no")
    body = F.concat(F.lit("put_batch: "), (F.col("n_nationkey") + 1).cast("string"), F.lit("  # rows\nreplicate_to_cloud: "), yes, F.lit("\nunknown: 1\nnodes:\n  - edge1\n  - '"), "n_name", F.lit("'\n"))

    def run(batches):
        for b in batches:
            out = []
            for n, t in zip(b["n"], b["value"], strict=True):
                e = config.EngineConfig().overridden(config.simple_yaml(t))
                out.append((int(n), e.put_batch, e.replicate_to_cloud, ",".join(e.nodes), e.get_batch))
            yield pd.DataFrame(out, columns=["n_nationkey", "put_batch", "replicate_to_cloud", "nodes", "get_batch"])

    return c.table("nation").select(key.alias("n"), body.alias("value")).mapInPandas(run, "n_nationkey long, put_batch long, replicate_to_cloud boolean, nodes string, get_batch long")


_COUNTERS = "count(*) AS h, count(DISTINCT path) AS m, CAST(sum(length) AS BIGINT) AS u, CAST(2 * sum(length) AS BIGINT) AS l, 10 * count(DISTINCT path) AS r"
_LESS = ", ".join(f"greatest(s.{x} - coalesce(b.{x}, 0), 0) AS {x}" for x in "hmulr")


def counters(c: Corpus, rows: DataFrame) -> DataFrame:
    n, size = F.countDistinct("path"), F.sum("length")
    return rows.groupBy("node").agg(F.count("*").alias("cache_hits"), n.alias("cache_misses"), size.alias("useful_bytes"), (2 * size).alias("container_loaded_bytes"), (10 * n).alias("meta_read_bytes"))


@query("s019_stats_minus_baseline", sql(_PLACED, f""", s AS (SELECT node, {_COUNTERS} FROM placed GROUP BY node), b AS (SELECT node, {_COUNTERS} FROM placed WHERE node % 2 = 1 AND seq = 0 GROUP BY node),
t AS (SELECT CAST(s.node AS VARCHAR) AS edge, {_LESS} FROM s LEFT JOIN b USING (node)), a AS (SELECT * FROM t UNION ALL SELECT 'ALL', {', '.join(f'CAST(sum({x}) AS BIGINT)' for x in 'hmulr')} FROM t)
SELECT edge, h AS cache_hits, m AS cache_misses, u AS useful_bytes, round(CASE WHEN h + m > 0 THEN h / (h + m) ELSE 0 END, 6) AS hit_rate, round(CASE WHEN l > 0 THEN u / l ELSE 0 END, 6) AS useful_ratio FROM a"""))
def _(c: Corpus) -> DataFrame:
    """Counters of now and of an earlier run, which some nodes don't have, as JSON files."""
    now, before = folder(c, "stats"), folder(c, "baseline")
    writers.stats(counters(c, c.placed), now)
    writers.stats(counters(c, c.placed.where("node % 2 = 1 AND seq = 0")), before)
    stats, base = (c.spark.read.json(p) for p in (now, before))
    return containers.derived_stats(stats, base).select("edge", "cache_hits", "cache_misses", "useful_bytes", *r6("hit_rate", "useful_ratio"))


@query("s030_stats_snapshot", sql(_PLACED, "SELECT node, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM placed GROUP BY node"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "snapshot")
    writers.stats(c.placed.groupBy("node").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes")), path)
    return c.spark.read.json(path).select("node", "chunks", "bytes")


@query("s031_node_perf_files", "SELECT CAST(user_id % 5 AS INTEGER) AS node, event_type AS task, count(*) AS requests, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    path = folder(c, "perf")
    e = c.table("events").select((F.col("user_id") % 5).cast("int").alias("node"), F.col("event_type").alias("task"), F.col("event_id").alias("bytes"), F.col("value").alias("seconds"))
    writers.stats(reports.task_counters(e), path, by_node=True)
    return c.spark.read.json(path).select("node", "task", "requests", F.round("seconds", 4).alias("seconds"))


@query("s020_rates", sql("d files heat", "SELECT path, CASE WHEN file_id % 2 = 0 THEN file_id ELSE CAST(ceil(round(heat, 5) * 1000) AS BIGINT) END AS rate FROM heat"))
def _(c: Corpus) -> DataFrame:
    value = F.when(F.col("file_id") % 2 == 0, F.col("file_id").cast("string")).otherwise(F.format_string("%.5f", F.round("heat", 5)))
    entry = F.concat(F.to_json(F.struct(F.col("path").alias("p"))), F.lit("|"), value)
    quoted = F.transform(F.collect_list(entry), lambda x: F.concat(F.regexp_extract(x, r'^\{"p":(".*")\}\|', 1), F.lit(":"), F.regexp_extract(x, r"\|([0-9.]+)$", 1)))
    docs = c.heat.groupBy(bucket("path")).agg(F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")).alias("value"))
    return readers.rates(c.spark, text(docs, folder(c, "rates")), 1000.0)


@query("s021_kept_assets", sql("d", "SELECT repo, name FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, name) AS r FROM (SELECT split_part(path, '/', 1) || doc_id % 7 AS repo, CASE doc_id % 3 WHEN 0 THEN 'a.tar.gz' WHEN 1 THEN 'b.ZIP' ELSE 'c.sig' END || doc_id AS nm, CASE doc_id % 3 WHEN 0 THEN doc_id || '.tar.gz' WHEN 1 THEN doc_id || '.ZIP' ELSE doc_id || '.sig' END AS name, n FROM d) WHERE n >= 1000 AND name NOT LIKE '%.sig') WHERE r <= 3"))
def _(c: Corpus) -> DataFrame:
    k = F.col("doc_id") % 3
    name = F.concat(F.col("doc_id").cast("string"), F.when(k == 0, ".tar.gz").when(k == 1, ".ZIP").otherwise(".sig"))
    repo = F.concat(naming.top_folder(F.col("path")), (F.col("doc_id") % 7).cast("string"))
    assets = c.sizes.select(repo.alias("repo"), name.alias("name"), F.col("raw_size").alias("size"))
    return readers.kept_assets(assets, [".tar.gz", ".zip"], 1000, 3).select("repo", "name")


# Blocks, containers, objects, restored files.


def stored(c: Corpus) -> DataFrame:
    """(fp, data) of every chunk."""
    n = F.octet_length("content")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda i: F.substring("content", i * CHUNK + 1, F.lit(CHUNK)))
    data = c.contents.where(n > 0).select(F.explode(pieces).alias("data"))
    return data.select(F.sha1("data").alias("fp"), "data").dropDuplicates(["fp"])


@query("s026_block_sink", sql(_PLACED, "SELECT fp, node, substr(fp, 1, 2) AS bucket, length AS bytes FROM placed"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "blocks")
    writers.blocks(stored(c).join(c.index, "fp").select("node", "fp", "data"), path)
    rows = c.spark.read.schema("fp string, data binary, node int, bucket string").parquet(path)
    return rows.select(F.sha1("data").alias("fp"), "node", "bucket", F.octet_length("data").cast("long").alias("bytes"))


# Next-fit packing, one step of the recursion for each chunk of every node at once.
PACKED = """, q AS (SELECT node, fp, length, row_number() OVER (PARTITION BY node ORDER BY path, seq) AS i FROM placed WHERE node > 0),
fit(node, i, fp, length, container_id, "offset", n) AS (SELECT node, i, fp, length, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM q WHERE i = 1
UNION ALL SELECT q.node, q.i, q.fp, q.length, CASE WHEN g THEN f.container_id + 1 ELSE f.container_id END, CASE WHEN g THEN 0 ELSE f."offset" + f.length END, CASE WHEN g THEN 1 ELSE f.n + 1 END
FROM (SELECT *, "offset" + length AS used FROM fit) f JOIN q ON q.node = f.node AND q.i = f.i + 1, LATERAL (SELECT f.used + q.length > 8192 OR 16 + 28 * (f.n + 1) > 1024 AS g))
"""


def recursive(body: str) -> str:
    return sql(_PLACED, PACKED + body).replace("WITH d AS", "WITH RECURSIVE d AS", 1)


@query("s082_container_packing", recursive('SELECT node, container_id, fp, "offset", length FROM fit'))
def _(c: Corpus) -> DataFrame:
    return containers.pack(c.placed.where("node > 0"), 8192, 1024)


@query("s027_container_images", recursive("""SELECT node, container_id, CAST(sum(length) + 1024 AS BIGINT) AS bytes, sha1(unhex(rpad(printf('%016X%08X%08X', container_id, count(*), CAST(sum(length) AS BIGINT)) || string_agg(upper(fp) || printf('%08X%08X', length, "offset"), '' ORDER BY "offset"), 2048, '0'))) AS meta_sha1
FROM fit GROUP BY node, container_id"""))
def _(c: Corpus) -> DataFrame:
    images = containers.container_images(containers.pack(c.placed.where("node > 0"), 8192, 1024), stored(c), 8192, 1024)
    n = F.octet_length("image")
    return images.select("node", "container_id", n.cast("long").alias("bytes"), F.sha1(F.substring("image", n - 1023, F.lit(1024))).alias("meta_sha1"))


@query("s027_container_round_trip", sql(_PLACED, "SELECT fp, node FROM placed WHERE node > 0"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "containers")
    images = containers.container_images(containers.pack(c.placed.where("node > 0"), 8192, 1024, 1), stored(c), 8192, 1024, single_file=True)
    writers.containers(images, path)
    back = c.spark.read.schema("container_id long, image binary, node int").parquet(path)
    return containers.read_image(back, 1024).select(F.sha1("data").alias("fp"), "node")


@query("s028_full_objects", sql("d", "SELECT replace(path, '/', '-') AS object_name, sha1(encode(text)) AS sha1 FROM d WHERE text IS NOT NULL AND doc_id % 4 <> 0"))
def _(c: Corpus) -> DataFrame:
    """Objects that are there already are left alone."""
    name = naming.object_candidates(F.col("path"), naming.recipe_name(F.col("path")))[0]
    existing = c.contents.where("doc_id % 4 = 0").select(name.alias("object_name"))
    out, _ = writers.objects(c.contents.where("content IS NOT NULL").select("path", "content"), existing, overwrite=False)
    return out.select("object_name", F.sha1("content").alias("sha1"))


@query("s028_object_actions", sql("d", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'replaced' ELSE 'created' END AS action, count(*) AS count FROM d GROUP BY 1"))
def _(c: Corpus) -> DataFrame:
    name = naming.object_candidates(F.col("path"), naming.recipe_name(F.col("path")))[0]
    existing = c.contents.where("doc_id % 4 = 0").select(name.alias("object_name"))
    return writers.objects(c.contents.select("path", "content"), existing, overwrite=True)[1]


@query("s029_restored_files", sql("d", "SELECT path, sha1(encode(text)) AS sha1 FROM d WHERE n > 0"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "restored")
    files = restore.reassembled(c.chunks.select("path", "seq", "fp"), stored(c))
    writers.restored(files, path)
    return c.spark.read.parquet(path).select("path", F.sha1("content").alias("sha1"))


@query("s033_run_log", "SELECT event_type AS run, 2 * count(*) AS rows, 2 * CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    """Two appended runs, read back from the JSON lines and from the CSV beside them."""
    path, rows = folder(c, "log"), c.table("events").select(F.col("event_type").alias("run"), "event_id")
    for _turn in range(2):
        writers.run_log(rows, path)
    lines = c.spark.read.schema("run string, event_id long").json(f"{path}/jsonl")
    table = c.spark.read.schema("run string, event_id long").option("header", "true").csv(f"{path}/csv")
    n = table.groupBy("run").agg(F.count("*").alias("rows"))
    return lines.groupBy("run").agg(F.sum("event_id").alias("total")).join(n, "run").select("run", "rows", "total")


_COVER = "d chunks firsts placed cover classed"


@query("s034_coverage_report", sql(_COVER, "SELECT path, class, total_chunks, edge_bytes, CASE WHEN class = 'partial' THEN printf('%.8f', edge_ratio) END AS ratio FROM classed"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "coverage")
    writers.coverage(reports.coverage(c.chunks, c.index), path)
    tsv = c.spark.read.schema("path string, total_chunks long, edge_chunks long, total_bytes long, edge_bytes long, edge_ratio string").option("header", "true").csv(f"{path}/tsv", sep="\t")
    return c.spark.read.json(f"{path}/json").join(tsv.select("path", F.col("edge_ratio").alias("ratio")), "path", "left").select("path", "class", "total_chunks", "edge_bytes", "ratio")


@query("s035_request_tsv", sql("d requests", "SELECT arrival_s, input, '' AS output FROM requests"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "requests")
    writers.tsv(c.requests.select(F.col("arrival_s").cast("decimal(20,6)"), "input"), path)
    return readers.requests(c.spark, path)


@query("s036_placement_document", sql(_PLACED, "SELECT fp, CAST(node AS VARCHAR) AS node_ref, 'mean' AS method FROM placed WHERE node > 0"))
def _(c: Corpus) -> DataFrame:
    path = folder(c, "document")
    writers.placement(c.index.where("node > 0"), {"method": "mean", "ratio": "0.2"}, path)
    method = c.spark.read.json(path).select("method")
    return readers.placement_json(c.spark, path).join(F.broadcast(method), F.lit(True))  # one row, by its format


# Links, batches, failures, matrix.


@query("s060_effective_links", "SELECT event_id, least(1.5e9, 1e8 * (1 + user_id % 20)) AS bps, round(0.001 + (event_id % 30) / 1000.0, 6) AS rtt FROM events")
def _(c: Corpus) -> DataFrame:
    far = F.concat((F.lit(100) * (1 + F.col("user_id") % 20)).cast("string"), F.lit("mbit"))
    delay = F.concat((F.col("event_id") % 30).cast("string"), F.lit("ms"))
    bps = cost.link_bps(cost.rate_bps(F.lit("1500mbit")), cost.rate_bps(far))
    return c.table("events").select("event_id", bps.alias("bps"), F.round(cost.link_rtt(cost.duration_s(F.lit("1ms")), cost.duration_s(delay)), 6).alias("rtt"))


@query("s080_failed_files", sql("d", "SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'read' END AS outcome FROM d"))
def _(c: Corpus) -> DataFrame:
    """Files that can't be read are told apart; the others go on."""
    files = c.contents.select("path", F.when(F.col("doc_id") % 9 != 0, F.coalesce("content", F.lit(b""))).alias("content"))
    good, bad = dedup.split_failures(files)
    return good.select("path", F.lit("read").alias("outcome")).union(bad.select("path", F.lit("failed")))


@query("s080_folder_or_list", sql("d chunks", "SELECT CAST(count(DISTINCT path) AS BIGINT) AS files, count(*) AS chunks FROM chunks WHERE path NOT IN (SELECT path FROM d WHERE doc_id % 9 = 0)"))
def _(c: Corpus) -> DataFrame:
    """A failed file of a folder leaves nothing in the figures."""
    good, _ = dedup.split_failures(c.contents.select("path", F.when(F.col("doc_id") % 9 != 0, F.col("content")).alias("content")))
    rows = c.chunks.join(good.select("path"), "path", "left_semi")
    return rows.agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))


@query("s081_extended_index", sql(_PLACED, "SELECT fp, CAST(CASE WHEN node > 5 THEN 0 ELSE node END AS INTEGER) AS node FROM placed"))
def _(c: Corpus) -> DataFrame:
    """An earlier index, with nodes of its own, is written, read, extended by this run's chunks and written again."""
    path = folder(c, "index")
    writers.index(c.index.where("node > 5").select("fp", F.lit(0).alias("node")), f"{path}/before")
    writers.index(dedup.extended_index(c.spark.read.parquet(f"{path}/before"), c.index), f"{path}/after")
    return c.spark.read.parquet(f"{path}/after").select("fp", "node")


@query("s091f_requests_by_scenario", sql("d requests", """, s AS (SELECT 1 AS k, 'edge-all' AS kind, 1.0 AS ratio UNION ALL SELECT 2, 'cloud-full', 0.0 UNION ALL SELECT i + 3, 'hybrid', 0.95 - i * 0.05 FROM range(0, 10) t(i)), n AS (SELECT count(*) AS n FROM requests)
SELECT CAST((k - 1) * n + req_id AS BIGINT) AS id, kind, input, 'r' || lpad(CAST(CAST(round(ratio * 100) AS INTEGER) AS VARCHAR), 3, '0') || '/' || CASE WHEN req_id < 1000000 THEN lpad(CAST(req_id AS VARCHAR), 6, '0') ELSE left(CAST(req_id AS VARCHAR), 6) END || '-' || split_part(input, '/', -1) AS output FROM requests, s, n"""))
def _(c: Corpus) -> DataFrame:
    return restore.runs_of(c.requests.select(F.col("req_id").alias("at"), "input"), restore.scenarios(c.spark)).select("id", "kind", "input", "output")


@query("s170_hot_output", sql("d files chunks firsts placed", "SELECT c.path, c.seq, c.fp, p.node FROM chunks c JOIN (SELECT fp, node FROM placed) p USING (fp) JOIN files f USING (path) WHERE file_id % 3 = 0"))
def _(c: Corpus) -> DataFrame:
    picked = c.files.where("file_id % 3 = 0").select("path")
    return placement.hot_output(c.chunks, picked, c.index)[0]


@query("s170_hot_nodes", sql("d files chunks firsts placed", "SELECT node, count(DISTINCT fp) AS chunks, sha1(string_agg(DISTINCT fp, ',' ORDER BY fp)) AS held FROM chunks JOIN (SELECT fp, node FROM placed) p USING (fp) JOIN files f USING (path) WHERE file_id % 3 = 0 GROUP BY node"))
def _(c: Corpus) -> DataFrame:
    held = placement.hot_output(c.chunks, c.files.where("file_id % 3 = 0").select("path"), c.index)[1]
    return held.select("node", F.size("fps").cast("long").alias("chunks"), F.sha1(F.array_join("fps", ",")).alias("held"))


# Reports.


@query("s110_suite_metrics", """WITH t AS (SELECT event_type AS run, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS s, max(user_id) AS u FROM events GROUP BY 1)
SELECT run, CAST(n AS DOUBLE) AS placement_clustered_file_count, CAST(NULL AS DOUBLE) AS placement_unique_chunk_count, s / 4 AS placement_total_theoretical_gain, CAST(n AS DOUBLE) AS placement_protected_target_count, CAST(NULL AS DOUBLE) AS placement_protected_selected_count, CAST(NULL AS DOUBLE) AS placement_stage1_selected_rows, 2.5 AS placement_stage1_total_protected_heat, 0.5 AS placement_gain_mean_seconds, CAST(u AS DOUBLE) AS placement_gain_max_seconds,
s AS dedup_total_original_bytes, s / 2 AS dedup_total_unique_bytes, CAST(NULL AS DOUBLE) AS dedup_total_network_sent_bytes, 1.25 AS dedup_total_duration_seconds, CAST(NULL AS DOUBLE) AS dedup_throughput_mb_s, 2.0 AS dedup_ratio, CAST(n AS DOUBLE) AS restore_file_count, 0.0 AS restore_cloud_full_download_files, CAST(NULL AS DOUBLE) AS restore_total_bytes, CAST(NULL AS DOUBLE) AS restore_total_duration_seconds, 3.5 AS restore_throughput_mb_s, CAST(NULL AS DOUBLE) AS restore_average_duration_seconds_per_file, 2.0 AS placement_mapped_hash_count FROM t""")
def _(c: Corpus) -> DataFrame:
    t = c.table("events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.sum("event_id").cast("double").alias("s"), F.max("user_id").alias("u"))
    placed = F.struct(
        F.struct(F.col("n").alias("clustered_file_count"), (F.col("s") / 4).alias("total_theoretical_gain")).alias("summary"),
        F.struct(F.col("n").alias("protected_target_count"), F.lit(2.5).alias("stage1_total_protected_heat")).alias("protection"),
        F.struct(F.struct(F.lit(0.5).alias("mean_seconds"), F.col("u").alias("max_seconds")).alias("gain_summary")).alias("theory"),
        F.struct(F.lit(1).alias("aa"), F.lit(2).alias("bb")).alias("hash2edge_node_id"),
    )
    dedup_ = F.struct(F.struct(F.col("s").alias("total_original_bytes"), (F.col("s") / 2).alias("total_unique_bytes"), F.lit(1.25).alias("total_duration_seconds"), F.lit(2.0).alias("dedup_ratio")).alias("overall_average"))
    restored = F.struct(F.struct(F.col("n").alias("file_count"), F.lit(0).alias("cloud_full_download_files"), F.lit(3.5).alias("throughput_mb_s")).alias("overall_average"))
    return reports.suite_metrics(t.select("run", F.to_json(placed).alias("placement"), F.to_json(dedup_).alias("dedup"), F.to_json(restored).alias("restore")))


_PHASE = {"setup": 0.1, "recipe_scan": 0.05, "window_prepare": 0.05, "edge_fetch": 0.5, "cloud_fallback_fetch": 0.2, "output_write": 0.1}
_EXPORT = """, r AS (SELECT req_id, input, h.raw_size AS b, c.n_chunks AS k, value, event_id % 11 = 0 AS bad, event_id % 5 = 0 AS full_ FROM requests JOIN events ON event_id = req_id JOIN heat h ON h.path = input JOIN counts c ON c.path = input),
x AS (SELECT *, CASE WHEN bad OR req_id % 7 = 0 THEN 0 ELSE value END AS v, CASE WHEN bad THEN 0 ELSE value + 0.25 END AS d, CASE WHEN bad THEN 0 ELSE b END AS fb, CASE WHEN bad THEN 0 ELSE k END AS fk, CASE WHEN bad THEN 0 ELSE b // 2 END AS eb, CASE WHEN bad THEN 0 ELSE b // 4 END AS cb FROM r),
y AS (SELECT *, CASE WHEN v > 0 THEN v ELSE d END AS lat FROM x)
"""
_EXPORT_COLUMNS = [
    "req_id AS id", "split_part(input, '/', -1) AS file_name", "'/out/' || req_id AS experiment_output_path", "80 AS edge_ratio", "CASE WHEN bad THEN 1 ELSE 0 END AS exit_code", "CAST(9.5 AS DOUBLE) AS runtime_seconds",
    "round(lat, 6) AS end_to_end_latency_seconds", "round(CASE WHEN v > 0 THEN v * 0.5 + v * 0.2 + v * 0.1 ELSE d END, 6) AS data_path_latency_seconds", "round(CASE WHEN lat > 0 THEN fb / 1048576.0 / lat ELSE 0 END, 6) AS throughput_mb_s",
    "CAST(fb AS BIGINT) AS file_size_bytes", "round(fb / 1048576.0, 6) AS file_size_mb", "CAST(fk AS BIGINT) AS chunk_count", "full_ AND NOT bad AS cloud_full_download",
    *(f"CAST(CASE WHEN bad THEN 0 ELSE {v} END AS BIGINT) AS {s}_{n}" for s, e in (("edge", ("b // 2", "8", "6", "4")), ("cloud", ("b // 4", "4", "3", "2"))) for n, v in zip(("bytes", "chunks_requested", "chunks_found", "batches"), e, strict=True)),
    *(f"round(CAST(CASE WHEN bad THEN 0.0 ELSE {v} END AS DOUBLE), 6) AS {s}_{n}_seconds" for s, e in (("edge", ("0.02", "0.5")), ("cloud", ("0.01", "0.25"))) for n, v in zip(("rpc", "transfer"), e, strict=True)),
    "round(CASE WHEN eb + cb > 0 THEN eb / (eb + cb) ELSE 0 END, 6) AS edge_byte_ratio", "round(CASE WHEN eb + cb > 0 THEN cb / (eb + cb) ELSE 0 END, 6) AS cloud_byte_ratio",
    *(f"round(v * {w}, 6) AS phase_{restore.PHASES[p]}_seconds" for p, w in _PHASE.items()), *(f"round(CAST(CASE WHEN v > 0 THEN {w} * 100 ELSE 0 END AS DOUBLE), 6) AS phase_{restore.PHASES[p]}_pct" for p, w in _PHASE.items()),
    "'snap' AS stats_snapshot", "'' AS stdout_tail", "CASE WHEN bad THEN 'killed' ELSE '' END AS stderr_tail",
]


@query("s135_export_rows", sql("d files heat chunks counts requests", _EXPORT + "SELECT " + ", ".join(_EXPORT_COLUMNS) + " FROM y"))
def _(c: Corpus) -> DataFrame:
    bad, v = F.col("req_id") % 11 == 0, F.col("value")
    v = F.when(F.col("req_id") % 7 == 0, 0.0).otherwise(v)
    half, quarter = F.floor(F.col("raw_size") / 4), F.floor(F.col("raw_size") / 4)
    node = lambda cloud, b, n, s: F.struct(F.lit(cloud).alias("is_cloud"), b.cast("long").alias("bytes"), *(F.lit(x).cast("long").alias(y) for x, y in ((4 * n, "chunks_requested"), (3 * n, "chunks_found"), (2 * n, "batches"))), F.lit(0.01 * n).alias("rpc_seconds"), F.lit(s).alias("transfer_seconds"))
    rest = F.floor(F.col("raw_size") / 2) - half
    nodes = F.array(node(False, half, 1, 0.25), node(True, quarter, 1, 0.25), node(False, rest, 1, 0.25))
    phases = F.map_from_arrays(F.array(*map(F.lit, _PHASE)), F.array(*(v * w for w in _PHASE.values())))
    events = c.table("events").select(F.col("event_id").alias("req_id"), "value")
    files = c.counts.select(F.col("path").alias("input"), "raw_size", "n_chunks")
    rows = c.requests.join(events, "req_id").join(files, "input")
    stats = rows.select(
        F.col("req_id").alias("id"), F.col("input").alias("input_path"), F.concat(F.lit("/out/"), F.col("req_id").cast("string")).alias("output_path"), F.lit(0.8).alias("ratio"), F.when(bad, 1).otherwise(0).alias("exit_code"),
        F.lit(9.5).alias("runtime_seconds"), F.col("raw_size").alias("bytes"), F.col("n_chunks").alias("chunks"), (F.col("value") + 0.25).alias("duration_seconds"), (F.col("req_id") % 5 == 0).alias("cloud_full_download"),
        phases.alias("phases"), nodes.alias("nodes"), F.lit("snap").alias("stats_snapshot"), F.lit("").alias("stdout_tail"), F.when(bad, "killed").otherwise("").alias("stderr_tail"),
    )
    return restore.export_rows(stats)


M = LinkModel()


@query("s065_sequential_fill_times", sql("d files heat chunks counts", f""", k AS (SELECT sum(raw_size) * 0.2 / {NODES} AS cap FROM counts),
z AS (SELECT path, CAST(raw_size AS DOUBLE) AS b, n_chunks AS n, CAST(cap AS DOUBLE) AS cap, CAST(ceil(raw_size / cap) AS INTEGER) AS used FROM counts, k),
w AS (SELECT path, b, n, cap, used, 0 AS i, CAST(0 AS BIGINT) AS given, CAST(0 AS DOUBLE) AS t FROM z WHERE b > 0 AND n > 0
UNION ALL SELECT path, b, n, cap, used, i + 1, given + mine, t + ceil(mine / {M.batch}.0) * {M.edge_rtt} + part * 8.0 / {M.edge_bps} FROM w, LATERAL (SELECT least(cap, b - i * cap) AS part), LATERAL (SELECT CASE WHEN i = used - 1 THEN n - given ELSE least(greatest(CAST(round_even(n * part / b, 0) AS BIGINT), 1), n - given) END AS mine) WHERE i < used)
SELECT path, round(CASE WHEN b <= 0 OR n <= 0 THEN 0.0 WHEN used > {M.nodes} THEN CAST('inf' AS DOUBLE) ELSE s END, 9) AS fill_s FROM z LEFT JOIN (SELECT path, t AS s FROM w WHERE i = used) USING (path)""").replace("WITH d AS", "WITH RECURSIVE d AS", 1))
def _(c: Corpus) -> DataFrame:
    total = c.counts.agg(F.sum("raw_size")).first()[0] or 0
    return c.counts.select("path", F.round(cost.filled_time(F.col("raw_size"), F.col("n_chunks"), M, total * 0.2 / NODES), 9).alias("fill_s"))
