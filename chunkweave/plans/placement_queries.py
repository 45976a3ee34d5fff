"""Similarity, communities and placement queries; the sequential selections have no SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.config import LinkModel
from chunkweave.functions import cost, hashing
from chunkweave.operators import catalog, graph, placement
from chunkweave.operators import select as S
from chunkweave.plans.corpus import JUMPED, NODES, Corpus, registry, sql

QUERIES, ORACLE_SQL, query = registry()
M = LinkModel()
_USE = "d files chunks use"


@query("s091c_file_overlaps", sql(_USE + " pairs", "SELECT u, v, shared_chunks, shared_bytes FROM pairs"))
def _(c: Corpus) -> DataFrame:
    return graph.overlaps(c.numbered_chunks)


_DIST = """, s AS (SELECT file_id, CAST(sum(length) AS BIGINT) AS b FROM chunks JOIN files USING (path) GROUP BY file_id),
x AS (SELECT p.u, p.v, p.shared_bytes AS i, a.b AS a, b.b AS b, 1.0 / pow(p.u, 0.7) AS hu, 1.0 / pow(p.v, 0.7) AS hv FROM pairs p JOIN s a ON a.file_id = p.u JOIN s b ON b.file_id = p.v)
SELECT u, v, round(CASE WHEN a + b - i <= 0 OR (hu + hv) / (a + b - i) < greatest(hu / a, hv / b) THEN 1.0 ELSE 1.0 - i / (a + b - i) END, 6) AS distance FROM x"""


@query("s137_pair_distances", sql(_USE + " pairs", _DIST))
def _(c: Corpus) -> DataFrame:
    return graph.pair_distances(c.numbered_chunks, c.heat).withColumn("distance", F.round("distance", 6))


_PARALLEL = f"CASE WHEN raw_size <= 0 OR n_chunks <= 0 THEN 0.0 ELSE ceil(n_chunks / ({M.batch}.0 * greatest(1, least({M.nodes}, n_chunks)))) * {M.edge_rtt} + raw_size / greatest(1, least({M.nodes}, n_chunks)) * 8.0 / {M.edge_bps} END"
_FROM_CLOUD = f"CASE WHEN raw_size <= 0 OR n_chunks <= 0 THEN 0.0 ELSE ceil(n_chunks / {M.batch}.0) * {M.cloud_rtt} + raw_size * 8.0 / {M.cloud_bps} END"
_GAINED = f""", g AS (SELECT file_id, heat * greatest(0.0, {_FROM_CLOUD} - ({_PARALLEL})) AS g FROM counts),
s AS (SELECT file_id, CAST(sum(length) AS BIGINT) AS b FROM chunks JOIN files USING (path) GROUP BY file_id),
x AS (SELECT p.u, p.v, p.shared_bytes AS i, a.b AS a, b.b AS b, ga.g AS gu, gb.g AS gv FROM pairs p JOIN s a ON a.file_id = p.u JOIN s b ON b.file_id = p.v JOIN g ga ON ga.file_id = p.u JOIN g gb ON gb.file_id = p.v)
SELECT u, v, round(CASE WHEN a + b - i <= 0 OR (gu + gv) / (a + b - i) < greatest(gu / a, gv / b) THEN 1.0 ELSE 1.0 - i / (a + b - i) END, 6) AS distance FROM x"""


@query("s138_gain_weighted_distances", sql("d files heat chunks counts use pairs", _GAINED))
def _(c: Corpus) -> DataFrame:
    gains = c.counts.select("file_id", (F.col("heat") * cost.gain(F.col("raw_size"), F.col("n_chunks"), M, parallel=True)).alias("score"))
    return graph.pair_distances(c.numbered_chunks, gains, "score").withColumn("distance", F.round("distance", 6))


@query("s122_chunk_hubs", sql(_USE, "SELECT fp, file_id, rank FROM (SELECT fp, file_id, row_number() OVER (PARTITION BY fp ORDER BY 1.0 / pow(file_id, 0.7) DESC, file_id) AS rank FROM use) WHERE rank <= 4"))
def _(c: Corpus) -> DataFrame:
    return graph.hubs(c.numbered_chunks, c.heat.select("file_id", F.col("heat").alias("benefit")), 4)


def benefits(c: Corpus) -> DataFrame:
    return c.heat.select("file_id", F.col("heat").alias("benefit"))


def labels(c: Corpus) -> DataFrame:
    return graph.communities(c.files.select("file_id"), graph.star_edges(c.kept_chunks, benefits(c)))


_COMM = sql(_USE, """, deg AS (SELECT fp, count(*) AS n, min(file_id) AS first FROM use GROUP BY fp),
hub AS (SELECT fp, file_id AS h FROM (SELECT fp, file_id, row_number() OVER (PARTITION BY fp ORDER BY 1.0 / pow(file_id, 0.7) DESC, file_id) AS r FROM use) WHERE r <= 2),
e AS (SELECT first AS u, file_id AS v FROM use JOIN deg USING (fp) WHERE n BETWEEN 2 AND 16 AND file_id <> first UNION SELECT least(h, file_id), greatest(h, file_id) FROM use JOIN deg USING (fp) JOIN hub USING (fp) WHERE n > 16 AND h <> file_id),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, b) AS (SELECT file_id, file_id FROM files UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON w.u = r.b),
lab AS (SELECT a AS file_id, min(b) AS community FROM reach GROUP BY a)
""").replace("WITH d AS", "WITH RECURSIVE d AS", 1)


@query("s154_communities", _COMM + "SELECT file_id, community FROM lab")
def _(c: Corpus) -> DataFrame:
    return labels(c)


@query("s156_community_bonus", _COMM + "SELECT file_id, community, n, round(1.0 / pow(file_id, 0.7) * (1 + CASE WHEN n > 1 THEN 0.5 * least(1.0, ln(1.0 + n) / ln(65.0)) ELSE 0 END), 6) AS benefit FROM lab JOIN (SELECT community, count(*) AS n FROM lab GROUP BY 1) USING (community)")
def _(c: Corpus) -> DataFrame:
    return graph.boosted(benefits(c), labels(c), 0.5).withColumn("benefit", F.round("benefit", 6))


@query("s123_hottest_prefixes", _COMM + """, r AS (SELECT community, file_id, row_number() OVER (PARTITION BY community ORDER BY 1.0 / pow(file_id, 0.7) DESC, file_id) AS r, count(*) OVER (PARTITION BY community) AS n FROM lab)
SELECT community, size, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY r) AS file_ids FROM r, (VALUES (2), (4), (8), (16), (32), (64)) t(size) WHERE r <= size AND size <= n GROUP BY ALL""")
def _(c: Corpus) -> DataFrame:
    p = graph.hottest_prefixes(labels(c), c.heat.select("file_id", F.col("heat").alias("score")))
    return p.select("community", "size", F.array_join(F.transform("file_ids", lambda x: x.cast("string")), ",").alias("file_ids"))


@query("s163_delta_graph_edges", sql(_USE + " pairs", "SELECT u, v, -shared_bytes AS cost FROM pairs"))
def _(c: Corpus) -> DataFrame:
    return delta(c)[1]


@query("s163_delta_graph_vertices", sql("d files heat chunks use", "SELECT h.file_id AS id, CAST(coalesce(m.mu, 0) AS BIGINT) AS mu, CAST(ceil(heat * 1000) AS BIGINT) AS prize FROM heat h LEFT JOIN (SELECT file_id, sum(size) AS mu FROM use GROUP BY 1) m USING (file_id)"))
def _(c: Corpus) -> DataFrame:
    return delta(c)[0]


def delta(c: Corpus) -> tuple[DataFrame, DataFrame]:
    files = c.heat.select("file_id", F.ceil(F.col("heat") * 1000).cast("long").alias("prize"))
    return graph.delta_graph(c.numbered_chunks, files)


@query("s164_split_graph", sql(_USE + " pairs", "SELECT u * 2 AS u, v * 2 AS v, -shared_bytes AS cost FROM pairs UNION ALL SELECT file_id * 2, file_id * 2 + 1, CAST(coalesce(mu, 0) AS BIGINT) FROM files LEFT JOIN (SELECT file_id, sum(size) AS mu FROM use GROUP BY 1) USING (file_id)"))
def _(c: Corpus) -> DataFrame:
    return graph.split_graph(*delta(c))[1]


@query("s162_jump_hash_placement", JUMPED + "SELECT fp, CAST(max(bucket) + 1 AS INTEGER) AS node FROM j WHERE nxt >= " + str(NODES) + " GROUP BY fp")
def _(c: Corpus) -> DataFrame:
    return catalog.first_seen(c.chunks).select("fp", hashing.jump_node(F.col("fp"), NODES).alias("node"))


@query("s119_closest_pairs", sql(_USE + " pairs", _DIST.replace("SELECT u, v, round(", ", p AS (SELECT u, v, round(").replace(" FROM x", """ FROM x),
k AS (SELECT max(distance) AS worst FROM (SELECT distance FROM p ORDER BY distance LIMIT 50)), q AS (SELECT p.*, worst, row_number() OVER (ORDER BY u, v) AS n, count(*) FILTER (distance < worst) OVER () AS less FROM p, k WHERE distance <= worst)
SELECT u, v, distance FROM q WHERE distance < worst OR n <= 50 QUALIFY distance < worst OR row_number() OVER (PARTITION BY distance = worst ORDER BY n DESC) <= 50 - less""")))
def _(c: Corpus) -> DataFrame:
    """The 50 closest pairs, as a scan that evicts the first of the worst keeps them."""
    pairs = graph.pair_distances(c.numbered_chunks, c.heat).withColumn("distance", F.round("distance", 6))
    return graph.closest_pairs(pairs, 50)


_SPARSE = """, deg AS (SELECT fp, count(*) AS n FROM use GROUP BY fp HAVING count(*) > 1),
hub AS (SELECT fp, file_id AS hub, row_number() OVER (PARTITION BY fp ORDER BY 1.0 / pow(file_id, 0.7) DESC, file_id) AS rank FROM use QUALIFY rank <= 4),
few AS (SELECT u.* FROM use u JOIN deg USING (fp) WHERE n <= 2), many AS (SELECT u.* FROM use u JOIN deg USING (fp) WHERE n > 2),
e AS (SELECT a.file_id AS u, b.file_id AS v, a.size FROM few a JOIN few b ON a.fp = b.fp AND a.file_id < b.file_id UNION ALL
SELECT least(file_id, hub), greatest(file_id, hub), size FROM (SELECT m.file_id, hub, size, row_number() OVER (PARTITION BY m.fp, m.file_id ORDER BY rank) AS nth FROM many m JOIN hub h ON h.fp = m.fp AND h.hub <> m.file_id) WHERE nth <= 2),
w AS (SELECT u, v, CAST(sum(size) AS BIGINT) AS weight FROM e GROUP BY ALL), own AS (SELECT file_id, sum(size) AS b FROM use GROUP BY 1)
SELECT u, v, weight FROM w JOIN own x ON x.file_id = u JOIN own y ON y.file_id = v WHERE weight >= 100 AND weight / least(x.b, y.b) >= 0.05"""


def sparse_edges(c: Corpus) -> DataFrame:
    own = c.numbered_chunks.select("file_id", "fp", "length").distinct().groupBy("file_id").agg(F.sum("length").alias("bytes"))
    return graph.thresholded(graph.sparse_graph(c.numbered_chunks, benefits(c), 2, 4, 2), own, 100, 0.05)


@query("s155_sparse_graph", sql(_USE, _SPARSE))
def _(c: Corpus) -> DataFrame:
    return sparse_edges(c)


@query("s157_community_greedy")
def _(c: Corpus) -> DataFrame:
    """(kind, id): communities picked, and files that are complete then; one task, as each pick depends on those before."""
    use = catalog.edges(c.kept_chunks, catalog.chunk_ids(c.kept_chunks)).select("file_id", "seq", "chunk_id", F.col("length").alias("size"))
    rows = use.join(labels(c), "file_id").join(benefits(c), "file_id").withColumn("g", F.lit(0))

    def fold(x):
        files = placement.by_file(x, "size")
        of = dict(zip(x["file_id"].tolist(), x["community"].tolist(), strict=True))
        names, groups = S.grouped(of)
        total = sum({k: s for ks in files.values() for k, s in ks}.values())
        picked, whole = S.community_greedy(groups, files, dict(zip(x["file_id"].tolist(), x["benefit"].tolist(), strict=True)), total * 0.2, S.Servers(NODES, total * 0.2 / NODES))
        out = [("community", names[i]) for i in picked] + [("file", f) for f in sorted(whole)]
        return type(x)(out, columns=["kind", "id"])

    return rows.groupBy("g").applyInPandas(fold, "kind string, id long")


_DEMO = [(1, "ABC", 2), (2, "ABCF", 1), (3, "AF", 1), (4, "BCG", 4), (5, "HGI", 5)]


@query("s171_demo_instance", "SELECT * FROM (VALUES (3, 'exact', 3, 5, '5'), (4, 'exact', 4, 6, '1,4'), (5, 'exact', 5, 9, '4,5'), (6, 'exact', 6, 11, '1,4,5'), (7, 'exact', 7, 13, '1,2,3,4,5')) t(budget, solver, cost, prize, picked)")
def _(c: Corpus) -> DataFrame:
    """The reference instance of five files, solved by enumeration for each budget."""

    def solve(batches):
        vertices = {f: (len(k), p) for f, k, p in _DEMO}
        edges = [(a, b, -len(set(k) & set(m))) for a, k, _ in _DEMO for b, m, _ in _DEMO if a < b and set(k) & set(m)]
        for x in batches:
            out = [(n, "exact", cost_, prize, ",".join(map(str, picked))) for n in x["budget"].tolist() for cost_, prize, picked in [S.dstp(vertices, edges, n)]]
            yield type(x)(out, columns=["budget", "solver", "cost", "prize", "picked"])

    return c.spark.range(3, 8).select(F.col("id").cast("int").alias("budget")).mapInPandas(solve, "budget int, solver string, cost int, prize int, picked string")


@query("s175_cached_matrix")
def _(c: Corpus) -> DataFrame:
    """A matrix of cells run twice over one folder: the second time nothing is run."""
    import uuid

    from chunkweave.staging import staged, staging

    path = f"{staging(c.spark)}/matrix-{uuid.uuid4().hex}"
    rows = [(f"{n}@{r}", n, r, NODES, None) for n in ("edge_only", "popularity_only") for r in (0.1, 0.2)]
    table = c.spark.createDataFrame(rows, "cell string, method string, ratio double, nodes int, protect double")
    edges, files = staged(chunk_edges(c), "edges"), staged(info(c), "info")
    placement.cached_cells(table, edges, files, path)
    out, ran = placement.cached_cells(table, edges, files, path)
    if ran:
        raise RuntimeError(f"{ran} cells were run again")
    return out


@query("s176_method_names", "SELECT * FROM (VALUES ('MEAN', 'mean'), ('LADedup-only', 'ladedup_only'), ('LADedup-two', 'ladedup_two'), ('directprotect_v2', 'ladedup_two'), ('version3', 'ladedup_only'), ('version4', 'theoretical_v4'), ('heat_only_spread', 'popularity_only'), ('Edge_only', 'edge_only'), ('Cloud_only', 'cloud_only'), ('Dedup_only', 'dedup_only'), ('topfirst_v1', 'topfirst_v1')) t(alias, method)")
def _(c: Corpus) -> DataFrame:
    names = [*placement.ALIASES, "topfirst_v1"]
    return c.spark.createDataFrame([(n, placement.method(n)) for n in names], "alias string, method string")


def info(c: Corpus) -> DataFrame:
    b, n, h = F.col("raw_size"), F.col("n_chunks"), F.col("heat")
    total = c.sizes.agg(F.sum("raw_size")).first()[0] or 0
    base = c.counts.withColumn("gain", h * cost.gain(b, n, M)).withColumn("gain_parallel", h * cost.gain(b, n, M, parallel=True))
    fill = F.greatest(F.lit(0.0), cost.full_time(b, n, M.cloud_bps, M.cloud_rtt, M.batch) - cost.filled_time(b, n, M, total * 0.2 / NODES))
    base = base.withColumn("gain_filled", h * fill)
    more = graph.boosted(base.select("file_id", F.col("gain").alias("benefit")), labels(c), 0.5)
    rows = base.join(more.select("file_id", F.col("benefit").alias("boosted")), "file_id")
    return rows.select("file_id", "heat", "raw_size", "gain", "gain_parallel", "gain_filled", "boosted")


def chunk_edges(c: Corpus) -> DataFrame:
    return catalog.edges(c.numbered_chunks, c.ids).select("file_id", "seq", "chunk_id", F.col("length").alias("size"))


def cells(c: Corpus, names: list[str]) -> DataFrame:
    """Cells over all files."""
    rows = [(f"{n}@0.2", n, 0.2, NODES, None) for n in names]
    table = c.spark.createDataFrame(rows, "cell string, method string, ratio double, nodes int, protect double")
    return placement.run_cells(table, chunk_edges(c), info(c))


@query("s143_density_methods")
def _(c: Corpus) -> DataFrame:
    return cells(c, ["mean", "theoretical_weighted", "ladedup_only", "theoretical_v4"])


@query("s145_protecting_methods")
def _(c: Corpus) -> DataFrame:
    return cells(c, ["topfirst_v1", "topfirst_v2", "directprotect_v1", "ladedup_two"])


@query("s148_completion_methods")
def _(c: Corpus) -> DataFrame:
    return cells(c, ["dedup_only", "greedy_benefit_size", "graph_community", "popularity_only"])


@query("s152_trivial_methods", sql("d files chunks firsts ids", f"SELECT 'edge_only@0.2' AS cell, 'file' AS kind, file_id AS id, CAST(0 AS INTEGER) AS node FROM files WHERE raw_size > 0 UNION ALL SELECT 'edge_only@0.2', 'chunk', chunk_id, CAST((chunk_id - 1) % {NODES} + 1 AS INTEGER) FROM ids"))
def _(c: Corpus) -> DataFrame:
    """cloud_only selects and places nothing, so it has no rows."""
    return placement.edge_only("edge_only@0.2", chunk_edges(c), NODES)


@query("s166_quota_selection")
def _(c: Corpus) -> DataFrame:
    """Budgets as rows; each is solved in a task of its own over all files."""
    vertices, edges = delta(c)
    total = vertices.agg(F.sum("mu")).first()[0] or 0
    budgets = c.spark.range(1, 5).select("id", (F.col("id") * (total // 4)).alias("budget"))
    v = vertices.select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"), F.col("mu").alias("cost"), "prize")
    e = edges.select("u", "v", "cost", F.lit(0).cast("long").alias("prize"))
    rows = F.broadcast(budgets.select(F.col("id").alias("n"))).join(v.union(e), F.lit(True))

    def solve(b, x):
        one = x["v"] == 0  # file ids start at 1
        table = {i: (m, p) for i, m, p in zip(x["u"][one].tolist(), x["cost"][one].tolist(), x["prize"][one].tolist(), strict=True)}
        links = list(zip(x["u"][~one].tolist(), x["v"][~one].tolist(), x["cost"][~one].tolist(), strict=True))
        out = [(n, *((r := S.dstp(table, links, n))[:2]), ",".join(map(str, r[2]))) for n in b["budget"].tolist()]
        return type(b)(out, columns=["budget", "cost", "prize", "picked"])

    return budgets.groupBy("id").cogroup(rows.groupBy("n")).applyInPandas(solve, "budget long, cost long, prize long, picked string")


@query("s169_budget_fill")
def _(c: Corpus) -> DataFrame:
    prizes = c.heat.select("file_id", F.ceil(F.col("heat") * 1000).cast("long").alias("prize"))
    rows = chunk_edges(c).join(prizes, "file_id").withColumn("g", F.lit(0))

    def fold(x):
        files = placement.by_file(x, "size")
        total = sum({k: s for ks in files.values() for k, s in ks}.values())
        picked = S.budget_fill(files, dict(zip(x["file_id"].tolist(), x["prize"].tolist(), strict=True)), total // 5)
        return type(x)({"rank": range(1, len(picked) + 1), "file_id": picked})

    return rows.groupBy("g").applyInPandas(fold, "rank long, file_id long")
