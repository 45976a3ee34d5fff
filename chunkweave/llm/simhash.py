"""SimHash near-duplicate detection with BK-trees inside exact shards.

Method. Every text gets a 64-bit SimHash. Two fingerprints at most `radius` bits apart agree
wholly in at least one of radius+1 bit blocks, so a shard is the set of distinct fingerprints
with one value in one block: every link lies inside some shard, none is lost, and no shard has
to meet all queries. In each shard a BK-tree (children keyed by integer Hamming distance to the
parent) is grown; a search follows only the edges within the radius. The shard's tree travels to
its own queries instead of being broadcast to all of them: a broadcast of all trees would grow
with the corpus. A shard above SHARD_MAX is split again by blocks of the bits that are left,
which is exact for the same reason and ends at 2**13 fingerprints at the latest.

similar_documents() is the form for a similarity threshold on sets of word shingles; its SimHash
takes each shingle once, as the similarity does. Texts 0.8 alike differ in up to RADIUS of 64 bits,
which is too many for bit blocks, so there a shard is the set of texts that share one of BANDS
min-wise bands of shingles (0.8 alike: all missed with probability 6e-4). The shard's BK-tree is
searched within RADIUS; where the min-wise signatures of what it finds agree to the similarity less
MARGIN (four standard errors), the shingle sets decide exactly. Only links that join classes leave
a task. A shard above SHARD_MAX is settled in slices first, then by one text of each class that is
left in it, again in slices, until its classes no longer become fewer; then the texts outside its
largest class meet all of its texts. So a hot group of copies costs a few passes over its texts, no
link that the bands show is lost, and no task grows. Of the recall test's 4,900 texts (tests/llm),
at least 0.99 of the pairs that are 0.8 or more alike end in one class.

Defined cases. Null, empty and wordless texts have fingerprint 0 and are linked like any other.
Repeated rows keep their own result row. Null doc_id: never the smallest id of a group unless
all its ids are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, components, staged, unstage, word_hashes

#: Fingerprints of one BK-tree; larger shards are split by further blocks.
SHARD_MAX = 2048
SEED = 42
_BLOCK = 1 << 16
#: Of similar_documents().
RADIUS, BANDS, ROWS, SIGNATURE, MARGIN = 20, 14, 4, 128, 0.14
_RANDOM = np.random.default_rng(2)
_MULT = _RANDOM.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_PERM = _RANDOM.integers(0, 2**63, (2, SIGNATURE), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of UTF-8 bytes: a bit is 1 if set in over half of the shingle hashes (XXH64, seed 42)."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] = iter([b" ".join(w)])
        n = 1
    else:
        n = len(w) - words + 1
        shingles = map(b" ".join, zip(*(w[i : i + n] for i in range(words)), strict=True))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class BKTree:
    """Burkhard-Keller tree over 64-bit integers in flat lists."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        """Insert x (which isn't there yet); its index."""
        at, new = 0, len(self.values)
        self.values.append(x)
        self.children.append({})
        if new:
            while True:
                d = (self.values[at] ^ x).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = new
                    break
                at = nxt
        return new

    def within(self, x: int, radius: int) -> list[int]:
        """Indexes of the values at most radius bits from x."""
        out: list[int] = []
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return out


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values into the classes which all links within the radius make."""
    tree, parent, out = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            if (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
                out.append((x, values[j]))
        tree.add(x)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("b")).mapInArrow(run, "doc_id long, fp long")


def _blocks(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Split runs (low bit, width) into so many lists of nearly equal width."""
    bits = [b for low, width in free for b in range(low, low + width)]
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    out = []
    for i in range(parts):
        runs: list[tuple[int, int]] = []
        for b in bits[cut[i] : cut[i + 1]]:
            if runs and sum(runs[-1]) == b:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((b, 1))
        out.append(runs)
    return out


def _mask(runs: list[tuple[int, int]]) -> int:
    m = sum(((1 << width) - 1) << low for low, width in runs)
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints fps(fp) that make the same classes as all links do."""
    todo = [(fps, [(0, 64)], 0)]
    out: DataFrame | None = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for values in b.column(0):
                found += tree_links([x & (2**64 - 1) for x in values.as_py()], radius)
            flat = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["u", "v"])

    while todo:
        part, free, fixed = todo.pop()
        blocks = _blocks(free, radius + 1)
        masks = [_mask(runs) | fixed for runs in blocks]
        keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        keyed = part.select("fp", F.explode(keys).alias("s")).select("fp", "s.*")
        sizes = keyed.groupBy("i", "k").agg(F.count("*").alias("n")).where("n > 1")
        keyed = staged(keyed.join(sizes, ["i", "k"]), "shards")
        trees = keyed.where(F.col("n") <= SHARD_MAX).groupBy("i", "k").agg(F.collect_list("fp").alias("fps"))
        got = trees.select("fps").mapInArrow(run, "u long, v long")
        out = got if out is None else out.union(got)
        hot = {r["i"] for r in keyed.where(F.col("n") > SHARD_MAX).select("i").distinct().collect()}
        for i in sorted(hot):  # at most radius + 1 block numbers
            taken = {b for low, width in blocks[i] for b in range(low, low + width)}
            left = [(b, 1) for low, width in free for b in range(low, low + width) if b not in taken]
            todo.append((keyed.where((F.col("n") > SHARD_MAX) & (F.col("i") == i)).select("fp"), left, masks[i]))
    assert out is not None  # there is at least one part
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text)."""
    d = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(d.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(links(distinct.select("fp"), radius))
    classed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = staged(classed.join(lows, "root").select("fp", "component_id"), "components")
    return d.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(w: list[bytes], words: int) -> np.ndarray:
    """Hashes of the word shingles in order; of fewer words the one of the whole sequence."""
    h = np.fromiter(map(word_hashes().__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1) if len(h) else 0
    grams = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        grams += h[j : j + n] * _MULT[j]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return grams ^ (grams >> np.uint64(32))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique((_shingles(text.lower().split(), words) >> np.uint64(16)).astype("<u4"))


def signature(text: bytes, words: int) -> tuple[bytes, int, np.ndarray]:
    """Class of equal word sequences; SimHash and min-wise signature (uint32) of the set of a text's word shingles."""
    w = text.lower().split()
    same = xxhash.xxh3_128_digest(b" ".join(w))
    grams = np.unique(_shingles(w, words))
    n = len(grams)
    if not n:
        return same, 0, np.zeros(SIGNATURE, np.uint32)
    ones = np.zeros(64, np.int64)
    low = np.full(SIGNATURE, 2**32 - 1, np.uint32)
    for at in range(0, n, 1024):
        part = grams[at : at + 1024]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        low = np.minimum(low, ((part[:, None] * _PERM[0] + _PERM[1]) >> np.uint64(32)).astype(np.uint32).min(0))
    return same, int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]), low


def alike_links(ids: list[int], fps: list[int], sigs: np.ndarray, sets: list[np.ndarray], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links between texts that join classes; with two sides only texts of different sides are compared."""
    parent, out, two = list(range(len(ids))), [], len(set(sides)) > 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    trees: dict[int, tuple[BKTree, dict[int, list[int]]]] = {}
    for i, x in enumerate(fps):
        for side, (tree, at) in trees.items():
            if two and side == sides[i]:
                continue
            mine = root(i)
            near = [j for k in tree.within(x, RADIUS) for j in at[k] if root(j) != mine]
            if near:
                agree = (sigs[near] == sigs[i]).mean(1)
                for j, a in zip(near, agree.tolist(), strict=True):
                    if a >= similarity - MARGIN and (r := root(i)) != (q := root(j)):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                            parent[max(r, q)] = min(r, q)
                            out.append((ids[i], ids[j]))
        tree, at = trees.setdefault(sides[i], (BKTree(), {}))
        known = next((k for k in tree.within(x, 0)), None)
        at.setdefault(tree.add(x) if known is None else known, []).append(i)
    return out


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each class one row of docs(doc_id, text, ...), that with the smallest doc_id (null last, ties to either).

    Texts are shuffled twice: those that share a shard to have their shingle sets sent there, and
    the survivors. The rest is narrow.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    written: list[DataFrame] = []

    def kept_for_now(df: DataFrame, tag: str) -> DataFrame:
        written.append(staged(df, tag))
        return written[-1]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = "_key"
    while own in docs.columns:
        own += "_"
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fps, sigs, bands = [], [], [], []
            for text in b.column(2).to_pylist():
                s, f, low = signature(text or b"", words)
                same.append(s)
                fps.append(f)
                sigs.append(low.astype("<u2").tobytes())
                bands.append([xxhash.xxh3_64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) >> 1 for i in range(BANDS)])
            more = [pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], ["key", "doc_id", "same", "fp", "sig", "bands"])

    text = F.encode("text", "UTF-8").alias("b")
    signed = keyed.select(F.col(own).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text)
    rows = kept_for_now(signed.mapInArrow(sign, "key long, doc_id long, same binary, fp long, sig binary, bands array<long>"), "signed")
    firsts = kept_for_now(rows.groupBy("same").agg(F.min(F.struct("doc_id", "key")).alias("low")).select("low", F.col("low.key").alias("node")), "classes")
    reps = rows.join(firsts.select(F.col("node").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    reps = kept_for_now(reps.select(F.col("key").alias("node"), "fp", "sig", "bands"), "representatives")
    banded = reps.select("node", F.explode("bands").alias("k"))
    sizes = banded.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    held = banded.join(sizes, "k").withColumn("slices", F.ceil(F.col("n") / SHARD_MAX).cast("int"))
    held = kept_for_now(held.withColumn("s", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")), "shards")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t or b"", words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "set"])

    needed = keyed.select(F.col(own).alias("node"), text).join(held.select("node").distinct(), "node", "left_semi").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])
    known = kept_for_now(reps.select("node", "fp", "sig").join(needed, "node"), "sets")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(have: list[tuple]) -> list[tuple[int, int]]:
            if len(have) < 2:
                return []
            sigs = np.frombuffer(b"".join([r[5] for r in have]), "<u2").reshape(len(have), -1)
            return alike_links([r[3] for r in have], [r[4] & (2**64 - 1) for r in have], sigs, [np.frombuffer(r[6], "<u4") for r in have], [r[7] for r in have], similarity)

        key, have = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if key != row[:3]:
                    out += found(have)
                    key, have = row[:3], []
                have.append(row)
            flat = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["u", "v"])
        flat = np.array(found(have), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["u", "v"])

    def linked(met: DataFrame) -> DataFrame:
        """Links of met(node, k, a, b, side) within each (k, a, b); with two sides only across them."""
        sent = met.join(known, "node").repartition(parts, "k", "a", "b").sortWithinPartitions("k", "a", "b")
        return kept_for_now(sent.select("k", "a", "b", "node", "fp", "sig", "set", "side").mapInArrow(link, "u long, v long"), "links")

    zero = F.lit(0)
    edges = linked(held.select("node", "k", F.col("s").alias("a"), zero.alias("b"), zero.alias("side")))
    roots = kept_for_now(components(edges), "roots")
    hot = kept_for_now(held.where("slices > 1").select("node", "k"), "hot")
    left, busy = None, not hot.isEmpty()
    while busy:
        classed = kept_for_now(hot.join(roots, "node", "left").select("node", "k", F.coalesce("root", "node").alias("root")), "classes")
        few = classed.groupBy("k", "root").agg(F.min("node").alias("node"), F.count("*").alias("size"))
        many = few.groupBy("k").agg(F.count("*").alias("m"), F.sum("size").alias("n"), F.max(F.struct("size", "root")).alias("main")).where("m > 1")
        few = kept_for_now(few.join(many, "k"), "few")
        now = few.count()
        if not now:
            break
        settled = left is not None and now > left * 0.9
        if not settled:
            slot = F.pmod(F.xxhash64("node", F.lit(now)), F.ceil(F.col("m") / SHARD_MAX)).cast("int")
            met = few.select("node", "k", slot.alias("a"), zero.alias("b"), zero.alias("side"))
        else:
            # The texts outside a band's largest class, in slices, with each slice of all its texts.
            each = classed.join(many, "k").withColumn("slices", F.ceil(F.col("n") / SHARD_MAX).cast("int")).withColumn("s", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
            others = each.where(F.col("root") != F.col("main.root"))
            count = others.groupBy("k").agg(F.ceil(F.count("*") / SHARD_MAX).cast("int").alias("parts"))
            others = others.join(count, "k").select("node", "k", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("a"), F.explode(F.sequence(zero, F.col("slices") - 1)).alias("b"), F.lit(1).alias("side"))
            met = others.union(each.join(count, "k").select("node", "k", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("a"), F.col("s").alias("b"), zero.alias("side")))
        edges = edges.union(linked(met))
        roots = kept_for_now(components(edges), "roots")
        left = now
        if settled:
            break

    classed = firsts.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "low")
    kept = staged(classed.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias(own)), "kept")
    for df in written:
        unstage(df)
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
