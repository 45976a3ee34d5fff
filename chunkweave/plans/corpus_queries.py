"""Queries over the corpus, each with its SQL oracle where SQL has one; sNNN is the survey's number."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.config import LinkModel
from chunkweave.functions import chunking, cost, hashing, naming
from chunkweave.operators import catalog, containers, dedup
from chunkweave.plans.corpus import CHUNK, FNV, JUMPED, NODES, Corpus, r6, registry, sql
from chunkweave.plans.io_queries import recursive
from chunkweave.sources import readers, writers
from chunkweave.staging import staging

QUERIES, ORACLE_SQL, query = registry()
M = LinkModel()


# Sources.


@query("s001_file_scan", sql("d files", "SELECT file_id, path, raw_size FROM files"))
def _(c: Corpus) -> DataFrame:
    return c.files.select("file_id", "path", "raw_size")


@query("s002_scan_outside_folder", sql("d", "SELECT path, n AS raw_size FROM d WHERE NOT starts_with(path, 'src1/')"))
def _(c: Corpus) -> DataFrame:
    return readers.filtered(c.sizes, skip_under="src1").select("path", "raw_size")


@query("s003_scan_by_extension", sql("d", "SELECT path FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN replace(path, '.txt', '.CSV') WHEN doc_id % 3 = 1 THEN replace(path, '.txt', '.log') ELSE path END AS path FROM d) WHERE lower(path) LIKE '%.csv' OR lower(path) LIKE '%.txt'"))
def _(c: Corpus) -> DataFrame:
    p, k = F.col("path"), F.col("doc_id") % 3
    named = c.sizes.select(F.when(k == 0, F.replace(p, F.lit(".txt"), F.lit(".CSV"))).when(k == 1, F.replace(p, F.lit(".txt"), F.lit(".log"))).otherwise(p).alias("path"))
    return readers.filtered(named, extensions=["csv", ".TXT"])


@query("s004_scan_by_glob", sql("d", "SELECT path FROM d WHERE regexp_matches(path, '/0000[0-9]*[1-4]\\.txt$') AND NOT path LIKE '%3.txt' ORDER BY path LIMIT 40"))
def _(c: Corpus) -> DataFrame:
    return readers.filtered(c.sizes.select("path"), include=["0000*[1-4].txt"], exclude=["*3.txt"], most=40)


@query("s005_fileinfo_round_trip", sql("d files chunks firsts ids", "SELECT f.file_id, f.path, k.seq, i.chunk_id, k.fp, k.length, k.off AS \"offset\" FROM chunks k JOIN files f USING (path) JOIN (SELECT chunk_id, fp FROM ids) i USING (fp)"))
def _(c: Corpus) -> DataFrame:
    path = f"{staging(c.spark)}/fileinfo-{uuid.uuid4().hex}"
    ids = c.ids
    writers.fileinfo(c.heat, ids, catalog.edges(c.chunks, ids), path, CHUNK)
    return readers.catalog_tables(readers.fileinfo(c.spark, path))[2].select("file_id", "path", "seq", "chunk_id", "fp", "length", "offset")


@query("s006_fileinfo_totals", sql("d files chunks firsts", "SELECT 'fastcdc' AS chunking_method, (SELECT CAST(sum(length) AS BIGINT) FROM chunks) AS total_size, (SELECT count(*) FROM firsts) AS unique_chunks, (SELECT count(*) FROM files) AS n_files"))
def _(c: Corpus) -> DataFrame:
    ids = c.ids
    info = writers.fileinfo_row(c.heat, ids, catalog.edges(c.chunks, ids), CHUNK).withColumn("chunking_method", F.lit(None).cast("string"))
    return readers.chunking_of(info).select("chunking_method", "total_size", F.size("uni_size").cast("long").alias("unique_chunks"), F.size("files").cast("long").alias("n_files"))


@query("s009_popularity_override", sql("d files heat", "SELECT path, round(h, 6) AS heat, round(CASE WHEN raw_size > 0 THEN h / raw_size ELSE 0 END, 9) AS heat_dsize FROM (SELECT path, raw_size, CASE WHEN starts_with(path, 'src0/') THEN file_id * 0.5 ELSE heat END AS h FROM heat)"))
def _(c: Corpus) -> DataFrame:
    path, heat = f"{staging(c.spark)}/popularity-{uuid.uuid4().hex}", c.heat
    given = heat.where(F.col("path").startswith("src0/")).select(F.col("path").alias("file"), (F.col("file_id") * 0.5).alias("heat"))
    given.write.option("header", "true").option("quoteAll", "true").csv(path)
    return catalog.override_heat(heat, readers.popularity(c.spark, path)).select("path", *r6("heat"), F.round("heat_dsize", 9).alias("heat_dsize"))


@query("s010_recipe_round_trip", sql("d chunks", "SELECT path, seq, fp FROM chunks"))
def _(c: Corpus) -> DataFrame:
    path, recipe = f"{staging(c.spark)}/recipes-{uuid.uuid4().hex}", c.chunks.select("path", "seq", "fp")
    writers.recipes(recipe, path)
    names = c.sizes.select("path", naming.recipe_name(F.col("path")).alias("file"))
    return readers.recipes(c.spark, path).join(names, "file").select("path", "seq", "fp")


@query("s015_request_lines", "SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN value END AS arrival_s, '/in/' || event_type AS input, CASE WHEN event_id % 2 = 1 THEN '/out/' || user_id ELSE '' END AS output FROM events")
def _(c: Corpus) -> DataFrame:
    k = F.col("event_id") % 4
    source, target = F.concat(F.lit("/in/"), "event_type"), F.concat(F.lit("/out/"), F.col("user_id").cast("string"))
    tab = F.when(F.col("event_id") % 8 < 4, "\t").otherwise("  ")
    line = F.when(k == 0, source).when(k == 1, F.concat(source, tab, target)).when(k == 2, F.concat(F.col("value").cast("string"), tab, source)).otherwise(F.concat(F.col("value").cast("string"), tab, source, tab, target))
    arrival, i, o = readers.request_fields(line)
    return c.table("events").select("event_id", arrival.alias("arrival_s"), i.alias("input"), o.alias("output"))


@query("s014_node_numbers", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 0 END AS INTEGER) AS node FROM events")
def _(c: Corpus) -> DataFrame:
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, u).when(k == 1, F.concat(F.lit("edge"), u)).when(k == 2, "Cloud").otherwise("nowhere")
    return c.table("events").select("event_id", readers.node_number(text).alias("node"))


# Chunking and hashing.


@query("s038_fixed_chunks", sql("d chunks", "SELECT path, seq, off AS \"offset\", length, fp FROM chunks"))
def _(c: Corpus) -> DataFrame:
    return c.chunks.select("path", "seq", "offset", "length", "fp")


# A step of the recursion for each chunk. A boundary is where the low bits of the gear sum over the bytes from the
# chunk's smallest size on are zero; g has the gear words' low 16 bits of all bytes of a file.
_GEAR_SUM = "list_filter(range({lo}, {hi}), lambda i: list_sum(list_transform(range(0, least({bits}, i - s + 1)), lambda k: g[i - k - a + 1] << k)) % {mask} = 0)[1]"


def defined_oracle(low: int, average: int, high: int, normalised: bool) -> str:
    base = round(math.log2(average))
    words = ", ".join(str(int(w) & 0xFFFF) for w in chunking.GEAR)
    hit = lambda lo, hi, bits: _GEAR_SUM.format(lo=lo, hi=hi, bits=bits, mask=1 << bits)
    if not normalised:
        found = hit("s", "e", base)
    else:
        found = f"coalesce({hit('s', f'least(e, a + {average - 1})', base + 1)}, {hit(f'greatest(s, least(e, a + {average - 1}))', 'e', base - 1)})"
    return sql("d", f""", gear AS MATERIALIZED (SELECT path, n, h, list_transform(range(0, n), lambda i: list_extract([{words}], CAST('0x' || substr(h, 2 * i + 2, 1) AS INTEGER) + 1)) AS gs FROM d WHERE n > 0),
w(path, seq, a, z) AS (SELECT path, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM gear
UNION ALL SELECT path, seq + 1, a, CASE WHEN n - a <= {low} THEN n ELSE coalesce({found} + 1, e) END
FROM (SELECT w.path, w.seq, w.z AS a, w.z + {low} AS s, least(q.n, w.z + {high}) AS e, q.n, q.gs[w.z + 1:least(q.n, w.z + {high})] AS g FROM w JOIN gear q USING (path) WHERE w.z < q.n))
SELECT path, seq, a AS "offset", z - a AS length, sha1(unhex(substr(h, 2 * a + 1, 2 * (z - a)))) AS fp FROM w JOIN gear USING (path) WHERE seq >= 0""").replace("WITH d AS", "WITH RECURSIVE d AS", 1)


@query("s040_content_defined_chunks", defined_oracle(64, 256, 1024, False))
def _(c: Corpus) -> DataFrame:
    return chunking.chunks(c.contents.select("path", "content"), "cdc", 256)


@query("s041_fast_content_defined_chunks", defined_oracle(64, 256, 1024, True))
def _(c: Corpus) -> DataFrame:
    return chunking.chunks(c.contents.select("path", "content"), "fastcdc", 256)


@query("s042_file_digests", sql("d", "SELECT path, sha1(encode(text)) AS sha1, sha256(encode(text)) AS sha256, 'run-' || substr(sha1(path), 1, 10) AS project FROM d"))
def _(c: Corpus) -> DataFrame:
    return c.contents.select("path", F.sha1("content").alias("sha1"), hashing.content_digest(F.col("content")).alias("sha256"), hashing.project_name("run", F.col("path")).alias("project"))


@query("s043_fnv_and_jump_hash", JUMPED + f"SELECT fp, CAST(any_value(k.h) AS VARCHAR) AS fnv, CAST(max(bucket) + 1 AS INTEGER) AS node FROM j JOIN k USING (fp) WHERE nxt >= {NODES} GROUP BY fp")
def _(c: Corpus) -> DataFrame:
    return c.chunks.select("fp").distinct().select("fp", hashing.fnv1a_64("fp").cast("string").alias("fnv"), hashing.jump_node(F.col("fp"), NODES).alias("node"))


@query("s046_synthetic_bytes", sql("d chunks firsts", "SELECT fp, length AS size, sha1(unhex(substr(repeat(fp, CAST(ceil(length / 20.0) AS BIGINT)), 1, 2 * length))) AS sha1 FROM firsts"))
def _(c: Corpus) -> DataFrame:
    first = catalog.first_seen(c.chunks).withColumnRenamed("length", "size")
    return first.select("fp", "size", F.sha1(chunking.filler(F.col("fp"), F.col("size"))).alias("sha1"))


# Names.


@query("s047_normalised_paths", sql("d", "SELECT path, path AS a, 'data/' || path AS b FROM d"))
def _(c: Corpus) -> DataFrame:
    odd = F.concat(F.lit("/./"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("/x/.."))
    return c.sizes.select("path", naming.normalised(odd).alias("a"), naming.logical("/data/", odd).alias("b"))


@query("s049_top_folders", sql("d", "SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM d GROUP BY 1"))
def _(c: Corpus) -> DataFrame:
    return c.sizes.groupBy(naming.top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("raw_size").alias("bytes"))


@query("s050_names", sql("d", r"""SELECT path, b || '-' || sha1(path) || '.recipe' AS recipe, replace(replace(replace(path, '/', '-'), '\', '-'), ':', '') || '.recipe' AS legacy, 'root/' || substr(sha1(path), 1, 2) || '/' || sha1(path) AS block
FROM (SELECT path, substr(regexp_replace(regexp_replace(split_part(path, '/', -1), '[^A-Za-z0-9._]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 96) AS b FROM d)"""))
def _(c: Corpus) -> DataFrame:
    p = F.col("path")
    return c.sizes.select("path", naming.recipe_name(p).alias("recipe"), naming.legacy_name(p).alias("legacy"), naming.block_path("root", F.sha1(p)).alias("block"))


@query("s052_recipe_resolution", sql("d", "SELECT path, CASE doc_id % 3 WHEN 0 THEN split_part(path, '/', -1) || '-' || sha1(path) || '.recipe' WHEN 1 THEN replace(path, '/', '-') || '.recipe' END AS recipe FROM d"))
def _(c: Corpus) -> DataFrame:
    p, k = F.col("path"), F.col("doc_id") % 3
    stored = c.sizes.select(F.when(k == 0, naming.recipe_name(p)).when(k == 1, naming.legacy_name(p)).alias("name")).where("name IS NOT NULL")
    return naming.resolved_recipes(c.sizes.select("path"), stored)


@query("s053_object_candidates", sql("d", "SELECT path, pos, CASE pos WHEN 0 THEN replace(path, '/', '-') WHEN 1 THEN split_part(path, '/', -1) || '-' || sha1(path) ELSE 'old-' || doc_id END AS name FROM d, (VALUES (0), (1), (2)) t(pos)"))
def _(c: Corpus) -> DataFrame:
    recipe = F.concat(F.lit("/data/recipe/old-"), F.col("doc_id").cast("string"), F.lit(".recipe"))
    return c.sizes.select("path", F.posexplode(naming.object_candidates(F.col("path"), recipe)).alias("pos", "name"))


@query("s054_object_names", "SELECT event_id, event_id % 4 IN (0) AS valid FROM events")
def _(c: Corpus) -> DataFrame:
    k = F.col("event_id") % 4
    name = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat(F.lit("a/"), "event_type")).when(k == 2, "..").otherwise("")
    return c.table("events").select("event_id", naming.valid_object(name).alias("valid"))


@query("s069_labels", sql("d", "SELECT path, upper(substr(path, 1, 0)) || CASE WHEN n % 1048576 = 0 AND n > 0 THEN CAST(n // 1048576 AS VARCHAR) || 'MB' WHEN n % 1024 = 0 AND n > 0 THEN CAST(n // 1024 AS VARCHAR) || 'KB' ELSE CAST(n AS VARCHAR) || 'B' END AS size_label, regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM d"))
def _(c: Corpus) -> DataFrame:
    return c.sizes.select("path", naming.size_label(F.col("raw_size")).alias("size_label"), naming.slug(F.col("path")).alias("slug"))


# Heat.


@query("s056_zipf_heat", sql("d files heat", "SELECT file_id, path, round(heat, 6) AS heat, round(heat_dsize, 9) AS heat_dsize FROM heat"))
def _(c: Corpus) -> DataFrame:
    return c.heat.select("file_id", "path", *r6("heat"), F.round("heat_dsize", 9).alias("heat_dsize"))


@query("s056_seeded_zipf_heat", sql("d files", "SELECT path, round(1.0 / pow(row_number() OVER (ORDER BY sha1('42|' || path)), 0.7), 6) AS heat FROM files"))
def _(c: Corpus) -> DataFrame:
    return catalog.zipf_heat(c.files, 0.7, 42).select("path", *r6("heat"))


@query("s058_shuffled_heat", sql("d files heat", "SELECT a.path, round(b.heat, 6) AS heat FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM heat) a JOIN (SELECT heat, row_number() OVER (ORDER BY sha1('7|' || path)) AS n FROM heat) b USING (n)"))
def _(c: Corpus) -> DataFrame:
    return catalog.shuffle_heat(c.heat, 7).select("path", *r6("heat"))


@query("s115_heat_rank", sql("d files heat", "SELECT file_id, row_number() OVER (ORDER BY heat DESC, file_id) AS heat_rank FROM heat"))
def _(c: Corpus) -> DataFrame:
    return catalog.by_heat(c.heat).select("file_id", "heat_rank")


@query("s116_protected_files", sql("d files heat", "SELECT file_id, path FROM heat ORDER BY heat DESC, file_id LIMIT (SELECT greatest(1, CAST(ceil(count(*) * 0.15) AS BIGINT)) FROM heat)"))
def _(c: Corpus) -> DataFrame:
    return catalog.protected(c.heat, 0.15).select("file_id", "path")


@query("s004_capped_files", sql("d", "SELECT path, n AS raw_size FROM d ORDER BY path LIMIT 25"))
def _(c: Corpus) -> DataFrame:
    return catalog.capped(c.sizes, 25).select("path", "raw_size")


# Cost model.

_FULL = "CASE WHEN raw_size <= 0 OR n_chunks <= 0 THEN 0.0 ELSE ceil(n_chunks / 128.0) * {rtt} + raw_size * 8.0 / {bps} END"
_EDGE, _CLOUD = _FULL.format(rtt=M.edge_rtt, bps=M.edge_bps), _FULL.format(rtt=M.cloud_rtt, bps=M.cloud_bps)
_PAR = "CASE WHEN raw_size <= 0 OR n_chunks <= 0 THEN 0.0 ELSE ceil(n_chunks / (128.0 * greatest(1, least(10, n_chunks)))) * 0.002 + raw_size / greatest(1, least(10, n_chunks)) * 8.0 / 1.5e9 END"


@query("s059_rates_and_durations", "SELECT rate, delay, CAST(bps AS DOUBLE) AS bps, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES ('1500mbit', '1ms', 1.5e9, 0.001), ('1gbit', '25ms', 1e9, 0.025), ('9600bps', '5us', 9600.0, 0.000005), ('8kbit', '2s', 8000.0, 2.0), ('fast', 'soon', NULL, NULL)) t(rate, delay, bps, seconds)")
def _(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame([("1500mbit", "1ms"), ("1gbit", "25ms"), ("9600bps", "5us"), ("8kbit", "2s"), ("fast", "soon")], "rate string, delay string")
    return rows.select("rate", "delay", cost.rate_bps(F.col("rate")).alias("bps"), F.round(cost.duration_s(F.col("delay")), 9).alias("seconds"))


@query("s061_restore_times", sql("d files heat chunks counts", f"SELECT path, n_chunks, round({_EDGE}, 9) AS edge_s, round({_CLOUD}, 9) AS cloud_s, round({_PAR}, 9) AS parallel_s, round(greatest(0, {_CLOUD} - {_EDGE}), 9) AS gain_s, round(greatest(0, {_CLOUD} - {_PAR}), 9) AS parallel_gain_s FROM counts"))
def _(c: Corpus) -> DataFrame:
    b, n = F.col("raw_size"), F.col("n_chunks")
    edge, cloud = cost.full_time(b, n, M.edge_bps, M.edge_rtt, M.batch), cost.full_time(b, n, M.cloud_bps, M.cloud_rtt, M.batch)
    return c.counts.select("path", "n_chunks", F.round(edge, 9).alias("edge_s"), F.round(cloud, 9).alias("cloud_s"), F.round(cost.parallel_time(b, n, M), 9).alias("parallel_s"), F.round(cost.gain(b, n, M), 9).alias("gain_s"), F.round(cost.gain(b, n, M, parallel=True), 9).alias("parallel_gain_s"))


@query("s062_hybrid_times", sql("d files heat chunks counts", """, h AS (SELECT path, n_chunks, raw_size, CAST(ceil(n_chunks * 0.7) AS BIGINT) AS ec, raw_size * CAST(0.7 AS DOUBLE) AS eb, raw_size - raw_size * CAST(0.7 AS DOUBLE) AS cb FROM counts)
SELECT path, round(CASE WHEN raw_size <= 0 OR n_chunks <= 0 THEN 0.0 ELSE greatest(CASE WHEN floor(eb) <= 0 OR ec <= 0 THEN 0.0 ELSE ceil(ec / 128.0) * 0.002 + floor(eb) * 8.0 / 1.5e9 END, CASE WHEN floor(cb) <= 0 OR n_chunks - ec <= 0 THEN 0.0 ELSE ceil((n_chunks - ec) / 128.0) * 0.05 + floor(cb) * 8.0 / 1e8 END) END, 9) AS hybrid_s FROM h"""))
def _(c: Corpus) -> DataFrame:
    return c.counts.select("path", F.round(cost.hybrid_time(F.col("raw_size"), F.col("n_chunks"), 0.7, M), 9).alias("hybrid_s"))


@query("s066_edge_by_hash_share", sql("d chunks", f"SELECT fp, {FNV} <= CAST({int(0.8 * float(2**64 - 1))} AS UBIGINT) AS edge FROM (SELECT DISTINCT fp FROM chunks)"))
def _(c: Corpus) -> DataFrame:
    return c.chunks.select("fp").distinct().select("fp", hashing.edge_by_ratio(F.col("fp"), 0.8).alias("edge"))


@query("s070_prizes", sql("d files heat", "SELECT path, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN 7 ELSE ceil(heat * 1000) END AS BIGINT) AS prize FROM heat"))
def _(c: Corpus) -> DataFrame:
    k = F.col("doc_id") % 3
    none = F.lit(None).cast("double")
    return c.heat.select("path", cost.prize(F.when(k == 0, F.col("doc_id")), F.when(k == 1, F.lit(7)), none, F.col("heat"), 1000.0).alias("prize"))


@query("s112_gain_summary", sql("d files heat chunks counts", f"SELECT round(avg(g), 9) AS mean_gain, round(max(g), 9) AS max_gain, round(min(g), 9) AS min_gain FROM (SELECT greatest(0, {_CLOUD} - {_EDGE}) AS g FROM counts)"))
def _(c: Corpus) -> DataFrame:
    from chunkweave.operators.reports import gain_summary

    g = gain_summary(c.counts.select(cost.gain(F.col("raw_size"), F.col("n_chunks"), M).alias("gain")))
    return g.select(*(F.round(x, 9).alias(x) for x in g.columns))


# Deduplication.


@query("s071_first_seen_ids", sql("d chunks firsts ids", "SELECT chunk_id, fp, size FROM ids"))
def _(c: Corpus) -> DataFrame:
    return c.ids


@query("s072_strict_placement", sql("d chunks firsts placed", "SELECT fp, node FROM placed"))
def _(c: Corpus) -> DataFrame:
    return c.index


@query("s073_round_robin", sql("d chunks firsts ids", f"SELECT fp, CAST((chunk_id - 1) % {NODES} + 1 AS INTEGER) AS node FROM ids"))
def _(c: Corpus) -> DataFrame:
    return dedup.place_round_robin(catalog.first_seen(c.chunks), NODES).select("fp", "node")


@query("s074_seeded_random_placement", sql("d chunks firsts", f"SELECT fp, CAST(CAST('0x' || substr(sha1('7|' || fp), 1, 13) AS BIGINT) % {NODES} + 1 AS INTEGER) AS node FROM firsts"))
def _(c: Corpus) -> DataFrame:
    return dedup.place_random(catalog.first_seen(c.chunks), NODES, 7).select("fp", "node")


@query("s075_put_batches", sql("d chunks firsts placed", "SELECT path, node, count(*) AS chunks, CAST(ceil(count(*) / 4.0) AS BIGINT) AS batches FROM placed GROUP BY ALL"))
def _(c: Corpus) -> DataFrame:
    return dedup.batches(c.placed, 4)


@query("s078_network_bytes", sql("d chunks firsts placed marked", "SELECT m.path, CAST(sum(CASE WHEN is_unique AND node > 0 THEN 48 ELSE 0 END) AS BIGINT) AS sent FROM marked m JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY m.path"))
def _(c: Corpus) -> DataFrame:
    return dedup.file_stats(c.marked, c.placed, False, "synthetic_edge").select("path", F.col("network_sent_bytes").alias("sent"))


@query("s079_synthetic_lengths", sql("d chunks firsts placed marked", """SELECT m.path, count(*) AS chunks, CAST(sum(CASE WHEN m.seq % 3 > 0 THEN m.length + m.seq % 2 ELSE m.length END) AS BIGINT) AS original_bytes, CAST(sum(CASE WHEN is_unique THEN m.length ELSE 0 END) AS BIGINT) AS unique_bytes,
CAST(sum(CASE WHEN is_unique THEN CASE WHEN node > 0 THEN 96 ELSE 48 END ELSE 0 END) AS BIGINT) AS network_sent_bytes FROM marked m JOIN (SELECT fp, node FROM placed) p USING (fp) GROUP BY m.path"""))
def _(c: Corpus) -> DataFrame:
    """A file's own chunk sizes count for its bytes, the unique chunk's size for what is stored; edges make the data."""
    given = F.when(F.col("seq") % 3 > 0, F.col("length") + F.col("seq") % 2).otherwise(0)
    out = dedup.file_stats(c.marked.withColumn("given", given), c.placed, True, "synthetic_edge")
    return out.select("path", "chunks", "original_bytes", "unique_bytes", "network_sent_bytes")


@query("s079_synthetic_dedup", sql("d files chunks firsts ids", f"SELECT path, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (node = 1) AS on_first FROM (SELECT c.path, c.length, (i.chunk_id - 1) % {NODES} + 1 AS node FROM chunks c JOIN (SELECT chunk_id, fp FROM ids) i USING (fp)) GROUP BY path"))
def _(c: Corpus) -> DataFrame:
    ids = dedup.place_modulo(c.ids, NODES)
    rows = c.chunks.join(ids.select("fp", "node"), "fp")
    return rows.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.count(F.when(F.col("node") == 1, 1)).alias("on_first"))


_PAGES = f"""p AS (SELECT 'page/' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS path, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
pc AS (SELECT path, i AS seq, sha1(unhex(substr(h, CAST(i * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK}))) AS fp, CAST(length(substr(h, CAST(i * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK})) // 2 AS BIGINT) AS length FROM p, unnest(range(0, CAST(ceil(n / {CHUNK}.0) AS BIGINT))) u(i) WHERE n > 0)"""


@query("s081_incremental_index", sql("d chunks", f", {_PAGES} SELECT path, seq, fp, length FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY path, seq) AS rn FROM pc WHERE fp NOT IN (SELECT fp FROM chunks)) WHERE rn = 1"))
def _(c: Corpus) -> DataFrame:
    path = F.concat(F.lit("page/"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    more = chunking.fixed_chunks(c.table("pages").select(path.alias("path"), F.encode("html", "UTF-8").alias("content")), CHUNK)
    return catalog.first_seen(more, c.chunks).select("path", "seq", "fp", "length")


@query("s083_container_resume", sql("d", "SELECT path, n // 1000 + 1 AS single_file, CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 0 END AS multi_file FROM d"))
def _(c: Corpus) -> DataFrame:
    has = F.col("doc_id") % 2 == 0
    return c.sizes.select("path", containers.resume_id(F.col("raw_size"), 1000, has, True).alias("single_file"), containers.resume_id(F.col("raw_size"), 1000, has, False).cast("int").alias("multi_file"))


# A least-recently-used list of four containers for each node, one step for each read.
_READS = """, size AS (SELECT node, container_id, CAST(sum(length) AS BIGINT) AS bytes FROM fit GROUP BY ALL),
r AS (SELECT f.node, f.container_id AS k, f.length, bytes, row_number() OVER (PARTITION BY f.node ORDER BY c.path || lpad(CAST(c.seq AS VARCHAR), 12, '0')) AS i FROM chunks c JOIN fit f USING (fp) JOIN size s ON s.node = f.node AND s.container_id = f.container_id),
lru(node, i, held, hits, misses, useful, loaded) AS (SELECT node, i, [k], CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(length AS BIGINT), bytes FROM r WHERE i = 1
UNION ALL SELECT l.node, r.i, CASE WHEN list_contains(held, k) THEN list_append(list_filter(held, lambda x: x <> k), k) WHEN len(held) >= 4 THEN list_append(held[2:], k) ELSE list_append(held, k) END,
hits + CAST(list_contains(held, k) AS BIGINT), misses + CAST(NOT list_contains(held, k) AS BIGINT), useful + r.length, loaded + CASE WHEN list_contains(held, k) THEN 0 ELSE bytes END FROM lru l JOIN r ON r.node = l.node AND r.i = l.i + 1)
SELECT node, hits AS cache_hits, misses AS cache_misses, useful AS useful_bytes, loaded AS container_loaded_bytes, 1024 * misses AS meta_read_bytes FROM lru QUALIFY row_number() OVER (PARTITION BY node ORDER BY i DESC) = 1"""


@query("s084_container_reads", recursive(_READS))
def _(c: Corpus) -> DataFrame:
    placed = c.placed.where("node > 0")
    packed = containers.pack(placed, 8192, 1024)
    reads = c.chunks.join(placed.select("fp", "node"), "fp").select("node", F.concat("path", F.lpad(F.col("seq").cast("string"), 12, "0")).alias("at"), "fp")
    return containers.read_stats(reads, packed, 4, 1024)


@query("s085_container_ratios", sql("d chunks firsts placed", """, s AS (SELECT node, count(*) AS h, count(DISTINCT path) AS m, CAST(sum(length) AS BIGINT) AS u FROM placed GROUP BY node),
t AS (SELECT CAST(node AS VARCHAR) AS edge, h, m, u, 2 * u AS l, 10 * m AS r FROM s UNION ALL SELECT 'ALL', CAST(sum(h) AS BIGINT), CAST(sum(m) AS BIGINT), CAST(sum(u) AS BIGINT), CAST(sum(2 * u) AS BIGINT), CAST(sum(10 * m) AS BIGINT) FROM s)
SELECT edge, h AS cache_hits, m AS cache_misses, u AS useful_bytes, l AS container_loaded_bytes, r AS meta_read_bytes, round(h / (h + m), 6) AS hit_rate, round(u / l, 6) AS useful_ratio, round((l + r) / u, 6) AS read_amplification FROM t"""))
def _(c: Corpus) -> DataFrame:
    s = c.placed.groupBy("node").agg(F.count("*").alias("cache_hits"), F.countDistinct("path").alias("cache_misses"), F.sum("length").alias("useful_bytes"), (2 * F.sum("length")).alias("container_loaded_bytes"), (10 * F.countDistinct("path")).alias("meta_read_bytes"))
    out = containers.derived_stats(s)
    return out.select("edge", "cache_hits", "cache_misses", "useful_bytes", "container_loaded_bytes", "meta_read_bytes", *r6("hit_rate", "useful_ratio", "read_amplification"))


@query("s086_put_and_get", sql("d chunks firsts placed", "SELECT fp, node > 5 AS existed, node > 5 AS found FROM placed"))
def _(c: Corpus) -> DataFrame:
    index = c.index.where("node > 5").select("fp", F.lit("0").alias("location"))
    put = dedup.puts(index.select("fp"), c.index.select("fp"))
    return put.join(dedup.gets(index, c.index.select("fp")).select("fp", "found"), "fp").select("fp", "existed", "found")


@query("s088_chunk_id_join", sql("d files chunks firsts ids", "SELECT f.file_id, c.seq, i.chunk_id FROM chunks c JOIN files f USING (path) JOIN (SELECT chunk_id, fp FROM ids) i USING (fp)"))
def _(c: Corpus) -> DataFrame:
    return catalog.edges(c.numbered_chunks, c.ids).select("file_id", "seq", "chunk_id")


@query("s092_dedup_file_stats", sql("d chunks firsts placed marked fstats", "SELECT *, round(CASE WHEN unique_bytes = 0 THEN 9999.0 ELSE original_bytes / unique_bytes END, 6) AS dedup_ratio FROM fstats"))
def _(c: Corpus) -> DataFrame:
    return dedup.file_stats(c.marked, c.placed, True).withColumn("dedup_ratio", F.round("dedup_ratio", 6))


@query("s093_dedup_overall", sql("d chunks firsts placed marked fstats", """, t AS (SELECT count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(unique_bytes) AS BIGINT) AS unique_bytes, CAST(sum(cloud_only_unique_chunks) AS BIGINT) AS cloud_only_unique_chunks, CAST(sum(cloud_only_unique_bytes) AS BIGINT) AS cloud_only_unique_bytes, CAST(sum(network_sent_bytes) AS BIGINT) AS network_sent_bytes FROM fstats)
SELECT *, round(original_bytes / unique_bytes, 6) AS dedup_ratio, round((unique_bytes - cloud_only_unique_bytes) / original_bytes, 6) AS edge_share, round(chunks / files, 6) AS avg_chunks, round(original_bytes / files, 6) AS avg_original_bytes, round(unique_bytes / files, 6) AS avg_unique_bytes, round(cloud_only_unique_chunks / files, 6) AS avg_cloud_only_unique_chunks, round(cloud_only_unique_bytes / files, 6) AS avg_cloud_only_unique_bytes, round(network_sent_bytes / files, 6) AS avg_network_sent_bytes FROM t"""))
def _(c: Corpus) -> DataFrame:
    o = dedup.overall(dedup.file_stats(c.marked, c.placed, True))
    return o.select(*(F.round(x, 6).alias(x) if t == "double" else x for x, t in o.dtypes))


@query("s094_folder_stats", sql("d chunks firsts placed marked fstats", "SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(unique_bytes) AS BIGINT) AS unique_bytes FROM fstats GROUP BY 1"))
def _(c: Corpus) -> DataFrame:
    return dedup.folder_stats(dedup.file_stats(c.marked, c.placed, True))


@query("s095_catalog_totals", sql("d chunks firsts", "SELECT count(*) AS chunks, CAST(sum(length) AS BIGINT) AS total_bytes, (SELECT count(*) FROM firsts) AS unique_chunks, (SELECT CAST(sum(length) AS BIGINT) FROM firsts) AS unique_bytes, round(sum(length) / (SELECT sum(length) FROM firsts), 6) AS ratio FROM chunks"))
def _(c: Corpus) -> DataFrame:
    return catalog.totals(c.chunks).withColumn("ratio", F.round("ratio", 6))


@query("s095_distinct_totals", sql("d chunks firsts", "SELECT (SELECT CAST(sum(length) AS BIGINT) FROM (SELECT DISTINCT path, fp, length FROM chunks)) AS file_bytes, CAST(sum(length) AS BIGINT) AS unique_bytes, count(*) AS unique_chunks FROM firsts"))
def _(c: Corpus) -> DataFrame:
    return catalog.distinct_totals(c.chunks)


@query("s096_chunk_degrees", sql("d chunks", "SELECT fp, max(length) AS size, count(DISTINCT path) AS degree, count(*) AS uses FROM chunks GROUP BY fp"))
def _(c: Corpus) -> DataFrame:
    return catalog.degrees(c.chunks)


@query("s096_postings", sql("d chunks", "SELECT fp, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT fp, path FROM chunks) GROUP BY fp"))
def _(c: Corpus) -> DataFrame:
    return catalog.postings(c.chunks).select("fp", F.array_join("paths", ",").alias("paths"))


@query("s117_running_offsets", sql("d chunks", "SELECT path, seq, CAST(coalesce(sum(length) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM chunks"))
def _(c: Corpus) -> DataFrame:
    return catalog.with_offsets(c.chunks).select("path", "seq", "offset")


@query("s151_edge_only", sql("d chunks firsts ids", f"SELECT chunk_id, CAST((chunk_id - 1) % {NODES} + 1 AS INTEGER) AS node FROM ids"))
def _(c: Corpus) -> DataFrame:
    return dedup.place_modulo(c.ids, NODES).select("chunk_id", "node")


def _register() -> None:
    from chunkweave.plans import io_queries, placement_queries, restore_queries

    for m in (restore_queries, placement_queries, io_queries):
        QUERIES.update(m.QUERIES)
        ORACLE_SQL.update(m.ORACLE_SQL)


_register()
