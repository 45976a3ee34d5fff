"""Files that share chunks: overlaps, distances, similarity graphs and communities.

Pairs come from chunks in common only; files without one have distance 1 and no row. A chunk that
very many files have makes many pairs: `most_degree` puts chunks above it into star edges on their
first file, which keeps communities whole.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.staging import numbered, staged


def _use(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id", "fp").agg(F.max("length").alias("size"), F.count("*").alias("uses"))


def overlaps(chunks: DataFrame, most_degree: int | None = None) -> DataFrame:
    """(u, v, shared_chunks, shared_bytes) for files u < v with a chunk in common."""
    use = _use(chunks).select("file_id", "fp", "size")
    if most_degree is not None:
        rare = use.groupBy("fp").count().where(F.col("count") <= most_degree)
        use = use.join(rare.select("fp"), "fp", "left_semi")
    other = use.select(F.col("file_id").alias("v"), "fp")
    pairs = use.withColumnRenamed("file_id", "u").join(other, "fp").where("u < v")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("shared_chunks"), F.sum("size").alias("shared_bytes"))


def pair_distances(chunks: DataFrame, scores: DataFrame, score: str = "heat") -> DataFrame:
    """(u, v, distance) of pairs that share a chunk.

    1 - shared / (a + b - shared), where a and b count repeated places and shared doesn't; 1 where
    the merged pair has less score for its bytes than the better of the two.
    """
    sizes = chunks.groupBy("file_id").agg(F.sum("length").alias("bytes")).join(scores.select("file_id", F.col(score).alias("score")), "file_id")
    a = sizes.select(F.col("file_id").alias("u"), F.col("bytes").alias("a"), F.col("score").alias("sa"))
    b = sizes.select(F.col("file_id").alias("v"), F.col("bytes").alias("b"), F.col("score").alias("sb"))
    rows = overlaps(chunks).join(a, "u").join(b, "v")
    union = F.col("a") + F.col("b") - F.col("shared_bytes")
    density = lambda s, n: F.when(n > 0, s / n).otherwise(F.lit(0.0))
    worse = density(F.col("sa") + F.col("sb"), union) < F.greatest(density(F.col("sa"), F.col("a")), density(F.col("sb"), F.col("b")))
    return rows.select("u", "v", F.when(worse | (union <= 0), F.lit(1.0)).otherwise(1.0 - F.col("shared_bytes") / union).alias("distance"))


def smallest_pairs(pairs: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """The k smallest in scan order: a smaller one evicts the first of the largest kept and goes to the end."""
    kept = Closest(k)
    for p in sorted(pairs, key=lambda x: x[:2]):
        kept.add(p)
    return kept.pairs()


class Closest:
    """The pairs that smallest_pairs keeps, given one by one in scan order."""

    def __init__(self, k: int) -> None:
        self.k, self.n = k, 0
        self.heap: list[tuple[float, int, tuple[int, int, float]]] = []

    @property
    def worst(self) -> float:
        """Pairs from this distance on aren't kept."""
        return math.inf if len(self.heap) < self.k else -self.heap[0][0] if self.heap else -math.inf

    def add(self, p: tuple[int, int, float]) -> None:
        entry = (-p[2], self.n, p)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif self.heap and p[2] < -self.heap[0][0]:
            heapq.heapreplace(self.heap, entry)
        self.n += 1

    def pairs(self) -> list[tuple[int, int, float]]:
        return [p for _, _, p in sorted(self.heap, key=lambda e: e[1])]


def merged_groups(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Clusters by one pass over the pairs for each starting pair; pairs behind are not revisited, so clusters may overlap."""
    used, out = [False] * len(pairs), []
    for i, (a, b) in enumerate(pairs):
        if used[i]:
            continue
        used[i], group, held = True, [a, b], {a, b}
        for j in range(i + 1, len(pairs)):
            if not used[j] and (pairs[j][0] in held or pairs[j][1] in held):
                used[j] = True
                group += [x for x in pairs[j] if x not in held]
                held.update(pairs[j])
        out.append(group)
    return out


def delta_graph(chunks: DataFrame, files: DataFrame, by_bytes: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices(id, mu, prize) and edges(u, v, cost): cost of a file alone, and the negative of what two share."""
    use = _use(chunks)
    mu = F.sum("size") if by_bytes else F.count("*")
    cost = use.groupBy("file_id").agg(mu.alias("mu"))
    vertices = files.join(cost, "file_id", "left").select(F.col("file_id").alias("id"), F.coalesce("mu", F.lit(0)).alias("mu"), "prize")
    edges = overlaps(chunks).select("u", "v", (-F.col("shared_bytes" if by_bytes else "shared_chunks")).alias("cost"))
    return vertices, edges


def split_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vertex in two, its cost on the edge between them; prizes scaled so that one outweighs all costs."""
    n = 2 * vertices.count()
    v0 = vertices.select((F.col("id") * 2).alias("id"), F.lit(0).cast("long").alias("prize")).union(vertices.select(F.col("id") * 2 + 1, (F.col("prize") * 2 * n + 1).cast("long")))
    inner = vertices.select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"), F.col("mu").alias("cost"))
    return v0, inner.union(edges.select(F.col("u") * 2, F.col("v") * 2, "cost"))


def hubs(chunks: DataFrame, benefit: DataFrame, most: int = 4) -> DataFrame:
    """(fp, file_id, rank): of each chunk the files with the largest benefit, ties by id."""
    rows = _use(chunks).join(benefit.select("file_id", "benefit"), "file_id")
    rank = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("benefit"), "file_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("fp", "file_id", "rank")


def star_edges(chunks: DataFrame, benefit: DataFrame, low_degree: int = 16, hub_count: int = 4, hub_edges: int = 2) -> DataFrame:
    """(u, v): edges that join the files of each chunk. Few files: all to the first; many: each to the chunk's best files."""
    use = _use(chunks).select("fp", "file_id")
    degree = use.groupBy("fp").agg(F.count("*").alias("n"), F.min("file_id").alias("first")).where("n > 1")
    low = use.join(degree.where(F.col("n") <= low_degree), "fp").where("file_id <> first").select(F.col("first").alias("u"), F.col("file_id").alias("v"))
    best = hubs(chunks, benefit, hub_count).where(F.col("rank") <= hub_edges).select("fp", F.col("file_id").alias("hub"))
    high = use.join(degree.where(F.col("n") > low_degree).select("fp"), "fp").join(best, "fp").where("file_id <> hub")
    return low.union(high.select(F.least("hub", "file_id"), F.greatest("hub", "file_id"))).distinct()


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(file_id, community): the smallest file reachable; nodes(file_id). Labels jump along themselves, so rounds are few."""
    both = staged(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = staged(nodes.select("file_id", F.col("file_id").alias("community")), "labels")
    for turn in range(rounds + 1):
        if turn == rounds:
            raise RuntimeError(f"labels still change after {rounds} rounds")
        near = both.join(labels.withColumnRenamed("file_id", "v"), "v").groupBy("u").agg(F.min("community").alias("low"))
        low = labels.join(near, labels["file_id"] == near["u"], "left").select("file_id", F.least("community", F.coalesce("low", "community")).alias("c"), F.col("community").alias("was"))
        jump = low.select(F.col("file_id").alias("c"), F.col("c").alias("next"))
        new = staged(low.join(jump, "c", "left").select("file_id", F.least("c", F.coalesce("next", "c")).alias("community"), "was"), "labels")
        labels = new.select("file_id", "community")
        if new.where("community <> was").isEmpty():
            break
    return labels


def community_bonus(n: Column, bonus: float) -> Column:
    """Factor of a file in a community of n: bonus * min(1, ln(1 + n) / ln 65), nothing for one alone."""
    return F.when(n > 1, F.lit(bonus) * F.least(F.lit(1.0), F.log(1.0 + n.cast("double")) / math.log(65))).otherwise(F.lit(0.0))


def boosted(benefit: DataFrame, labels: DataFrame, bonus: float) -> DataFrame:
    """benefit(file_id, benefit) times 1 + the bonus of the file's community."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    rows = benefit.join(labels, "file_id").join(sizes, "community")
    return rows.select("file_id", "community", "n", (F.col("benefit") * (1.0 + community_bonus(F.col("n"), bonus))).alias("benefit"))


def hottest_prefixes(labels: DataFrame, scores: DataFrame, sizes: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    """(community, size, file_ids): the best files of each community in prefixes of growing size."""
    rows = labels.join(scores, "file_id").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "file_id")))
    rows = rows.where(F.col("r") <= max(sizes))
    total = rows.groupBy("community").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("r", "file_id"))).alias("l"))
    each = total.select("community", "n", "l", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where("size <= n")
    return each.select("community", "size", F.transform(F.slice("l", 1, F.col("size")), lambda x: x["file_id"]).alias("file_ids"))


def closest_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """smallest_pairs() of pairs(u, v, distance) as a table.

    Pairs below the k-th smallest distance stay. Of those at it the first k to come were let in, pairs
    below it counted, and the earliest of them had to go again.
    """
    worst = pairs.select("distance").orderBy("distance").limit(k).agg(F.max("distance").alias("worst"))
    near = pairs.join(F.broadcast(worst), F.col("distance") <= F.col("worst"))  # one row
    near = staged(numbered(near.select("u", "v", "distance", "worst"), ["u", "v"], "n"), "near")
    below = near.where("distance < worst")
    left = max(0, k - below.count())
    ties = near.where((F.col("distance") == F.col("worst")) & (F.col("n") <= k)).orderBy(F.desc("n")).limit(left)
    return below.select("u", "v", "distance").union(ties.select("u", "v", "distance"))


def sparse_graph(chunks: DataFrame, benefit: DataFrame, pair_degree: int = 16, hub_count: int = 4, hub_edges: int = 2) -> DataFrame:
    """(u, v, weight): bytes of chunks over which two files are joined.

    A chunk of up to pair_degree files joins all of them, one of more each of its files to the best
    hub_edges of its hub_count files with the largest benefit. So a chunk of n files makes less than
    n * pair_degree / 2 or 2 * n * hub_edges rows.
    """
    use = _use(chunks)
    degree = use.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    few, many = (use.join(degree.where(x), "fp").select("fp", "file_id", "size") for x in (F.col("n") <= pair_degree, F.col("n") > pair_degree))
    both = few.select("fp", F.col("file_id").alias("u"), "size").join(few.select("fp", F.col("file_id").alias("v")), "fp").where("u < v").select("u", "v", "size")
    best = hubs(chunks, benefit, hub_count).withColumnRenamed("file_id", "hub")
    star = many.join(best, "fp").where("file_id <> hub")
    nth = F.row_number().over(Window.partitionBy("fp", "file_id").orderBy("rank"))
    star = star.withColumn("nth", nth).where(F.col("nth") <= hub_edges)
    star = star.select(F.least("file_id", "hub").alias("u"), F.greatest("file_id", "hub").alias("v"), "size")
    return both.union(star).groupBy("u", "v").agg(F.sum("size").alias("weight"))


def thresholded(edges: DataFrame, own_bytes: DataFrame, least_bytes: float, least_share: float) -> DataFrame:
    """Edges of at least that weight and that share of the smaller file's bytes; own_bytes(file_id, bytes)."""
    a, b = (own_bytes.select(F.col("file_id").alias(k), F.col("bytes").alias(f"_{k}")) for k in ("u", "v"))
    small = F.least("_u", "_v")
    share = F.when(small > 0, F.col("weight") / small).otherwise(0.0)
    return edges.join(a, "u").join(b, "v").where((F.col("weight") >= least_bytes) & (share >= least_share)).select("u", "v", "weight")


def capped_communities(n_files: int, weighted: list[tuple[int, int, float]], least: float, most: int) -> list[list[int]]:
    """Breadth-first groups along edges of at least that weight, strongest first, at most so many files each."""
    near: dict[int, list[tuple[float, int]]] = {}
    for u, v, w in weighted:
        if w >= least:
            near.setdefault(u, []).append((-w, v))
            near.setdefault(v, []).append((-w, u))
    seen, out = set(), []
    for start in range(1, n_files + 1):
        if start in seen:
            continue
        seen.add(start)
        group, at = [start], 0
        while at < len(group) and len(group) < most:
            for _, v in sorted(near.get(group[at], ())):
                if v not in seen and len(group) < most:
                    seen.add(v)
                    group.append(v)
            at += 1
        out.append(group)
    return out
