"""A content-addressed store of token ids.

Method. A gear hash rolls over each document's ids and cuts them into chunks; a chunk's address is
its digest. Every distinct chunk is stored once, in the pack row of the smallest document that has
it; a document's recipe lists the digests, in order, with their lengths, and says which are stored
elsewhere. Pack files, and the rows in them, are in ascending doc_id order, with each document's
start in the whole id stream. A document's root is over its doc_id, start, length and the Merkle
root of its recipe; a range's manifest is over its documents' roots; the store's root is over the
manifests, whose ranges follow each other. Reading compares the manifests both ways, follows their
starts up to the store's root, resolves foreign chunks by digest, rebuilds each document, and
verifies every chunk's digest and the document's root, or raises.

Skew. A range's bounds come from the doc_ids; an id that fills several ranges is dealt to all of
them by its text. Joins on a digest are plain sort-merge joins, of which AQE splits a hot digest's uses.

Defined cases. A null text is empty and has the end id only. Documents are ordered by doc_id (null
first); repeated rows of one doc_id are in any order, and each keeps its own start. An empty table
gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, listed, staged, unstage

SMALLEST, AVERAGE_BITS, LARGEST = 64, 8, 1024
DIGEST = 16
OWN, SHARED, FOREIGN = 0, 1, 2
_GEAR = np.random.default_rng(8).integers(0, 2**32, 1 << 16, np.uint32)
_WINDOW = 16


def places(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows of 16 ids whose rolling hash has AVERAGE_BITS leading zeros; the first 15 windows are shorter."""
    h = _GEAR[ids & 0xFFFF]
    for width in (1, 2, 4, 8):
        if len(ids) > width:
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint32(2 * width)
            h = longer
    return np.flatnonzero(h < np.uint32(1 << (32 - AVERAGE_BITS))) + 1


def cuts(n: int, found: list[int]) -> list[int]:
    """Chunk ends of n ids: the ascending places found, where the chunk is neither too short nor too long."""
    out, start = [], 0
    for at in found:
        while at - start > LARGEST:
            start += LARGEST
            out.append(start)
        if at - start >= SMALLEST:
            out.append(at)
            start = at
    while n - start > LARGEST:
        start += LARGEST
        out.append(start)
    return [*out, n] if start < n else out


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd one goes up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1)
def _zip() -> zstandard.ZstdCompressor:
    """One for each Python worker."""
    return zstandard.ZstdCompressor(level=3)


@lru_cache(maxsize=1)
def _unzip() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed(ids: np.ndarray) -> bytes:
    """Ids as they are stored: two bytes each where they fit, then compressed."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([wide]) + _zip().compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_unzip().decompress(data[1:]), "<u4" if data[0] else "<u2").astype("<u4")


def leaf(doc: int | None, start: int, n: int, recipe: bytes) -> bytes:
    """Root of a document: over its id, place and length, and its recipe's root."""
    return address(repr((doc, start, n)).encode() + b"\2" + recipe)


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Lowest doc_ids of all ranges but the first; an id that fills several ranges is there several times."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("b")).first()["b"] or [] if parts > 1 else []


def encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(part, doc_id, n_tokens, ids binary, digests array<binary>, lengths array<int>, root binary); part is the number of doc_id's range."""
    bounded_batches(docs.sparkSession)
    schema = "part int, doc_id long, n_tokens long, ids binary, digests array<binary>, lengths array<int>, root binary"
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunkweave.llm.tokens import words_of

        words, limits = words_of(tokenizer, byte_level=True), np.array(bounds, np.int64)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            every, ends = words.encode(b.column(1), end_id)
            found = places(every)  # windows that begin in the text before end within a text's first SMALLEST ids, where no chunk ends
            of = np.searchsorted(found, ends, "right").tolist()
            data, ends, found = every.astype("<u4").tobytes(), ends.tolist(), found.tolist()
            for k, (first, last) in enumerate(zip(ends, ends[1:], strict=False)):
                ids, at, digests, lengths = every[first:last], first, [], []
                for to in cuts(last - first, [x - first for x in found[of[k] : of[k + 1]]]):
                    digests.append(address(data[4 * at : 4 * (first + to)]))
                    lengths.append(first + to - at)
                    at = first + to
                for c, v in zip(cols, (len(ids), packed(ids), digests, lengths, merkle(digests)), strict=True):
                    c.append(v)
            key = b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(limits, key, "left"), np.searchsorted(limits, key, "right")
            deal = np.array([zlib.crc32(r) for r in cols[4]], np.int64)
            part = np.where(high > low, low + 1 + deal % np.maximum(high - low, 1), high)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _starts(rows: DataFrame) -> DataFrame:
    """rows(part, k, row, n_tokens) with `start`: sums within ranges, after those of all ranges before."""
    sums, before, at = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}, [], 0
    for k in sorted(sums):  # one row for each range
        before.append((k, at))
        at += sums[k]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    order = Window.partitionBy("part").orderBy("k", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return out.join(F.broadcast(offsets), "part").select("part", "k", "row", (F.col("start") + F.col("before")).alias("start"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Packs under path/packs, manifests under path/manifests. Ids are shuffled once, to their range."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(encoded(docs, tokenizer, end_id, _bounds(docs, parts)).withColumn("row", F.monotonically_increasing_id()), "ids")
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    starts = _starts(rows.select("part", key.alias("k"), "row", "n_tokens"))

    # Where each chunk that more than one place has is stored: the first document's first place.
    uses = rows.select(key.alias("k"), "row", F.posexplode("digests").alias("at", "digest"))
    homes = uses.groupBy("digest").agg(F.min(F.struct("k", "row", "at")).alias("home"), F.count("*").alias("n")).where("n > 1")
    held = uses.join(homes, "digest").select("row", "at", F.when((F.col("row") == F.col("home.row")) & (F.col("at") == F.col("home.at")), SHARED).otherwise(FOREIGN).alias("state"))
    states = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "state"))).alias("states"))
    placed = starts.join(states, "row", "left")

    names = ["part", "doc_id", "start", "n_tokens", "own", "digests", "lengths", "states", "root"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    body = ["doc_id", "n_tokens", "ids", "digests", "lengths", "root"]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in body]
    tagged = placed.select("part", "k", "row", F.lit(0).alias("last"), "start", "states", *none).union(
        rows.select("part", key, "row", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("map<int,int>"), *body)
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, marks = None, {}
        for b in batches:
            out = []
            for part, last, start_, marks_, doc, n, ids, digests, lengths, root in zip(*(listed(b.column(i)) for i in range(10)), strict=True):
                if not last:
                    start, marks = start_, dict(marks_ or ())
                    continue
                said = [marks.get(i, OWN) for i in range(len(lengths))]
                if FOREIGN in said:
                    every, to = unpacked(ids), np.cumsum(lengths)
                    mine = [every[e - m : e] for e, m, state in zip(to, lengths, said, strict=True) if state != FOREIGN]
                    ids = packed(np.concatenate(mine) if mine else every[:0])
                out.append((part, doc, start, n, ids, digests, lengths, bytes(said), leaf(doc, start, n, root)))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "part int, doc_id long, start long, n_tokens long, own binary, digests array<binary>, lengths array<int>, states binary, root binary"
    dealt = tagged.repartitionById(parts, "part").sortWithinPartitions("part", "k", "row", "last")  # the n-th file holds the n-th range
    dealt.select("part", "last", "start", "states", *body).mapInArrow(place, schema).write.parquet(f"{path}/packs")
    unstage(rows)
    manifests = staged(_manifests(spark, path), "manifests")
    manifests.coalesce(1).write.parquet(f"{path}/manifests")  # one row for each range
    unstage(manifests)
    spark.createDataFrame([_top(spark.read.parquet(f"{path}/manifests"))], _TOP).coalesce(1).write.parquet(f"{path}/top")


_TOP = "documents long, tokens long, root binary"


def _top(manifests: DataFrame) -> tuple[int, int, bytes]:
    """Documents, ids and root of the store; raises where a range doesn't begin at the end of the one before. One row for each range comes here."""
    documents = tokens = 0
    leaves = []
    for r in sorted(manifests.collect(), key=lambda r: r["part"]):
        if r["first"] != tokens:
            raise ValueError("the ranges don't follow each other")
        documents, tokens = documents + r["documents"], tokens + r["tokens"]
        leaves.append(address(repr((r["part"], r["documents"], r["tokens"], r["first"])).encode() + b"\3" + bytes(r["root"])))
    return documents, tokens, merkle(leaves)


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """(part, documents, tokens, first, root) of each range: the Merkle root of its documents' roots in order."""
    roots = spark.read.parquet(f"{path}/packs").select("part", "start", "n_tokens", "root")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list] = {}
        for b in batches:
            for part, start, n, root in zip(*(listed(b.column(i)) for i in range(4)), strict=True):
                x = have.setdefault(part, [0, 0, start, []])
                if start != x[2] + x[1]:
                    raise ValueError("the documents of a range don't follow each other")
                x[0] += 1
                x[1] += n
                x[3].append(root)
        out = [(k, n, t, f, merkle(r)) for k, (n, t, f, r) in have.items()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "documents", "tokens", "first", "root"])

    return roots.repartition(parts, "part").sortWithinPartitions("part", "start").mapInArrow(run, "part int, documents long, tokens long, first long, root binary")


def _result(kind: str):
    def of(ids: bytes) -> tuple:
        return (len(ids) // 4, zlib.crc32(ids)) if kind == "digest" else (len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<u4").tolist())

    return of


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, rebuilt and verified."""
    bounded_batches(spark)
    stored, found = spark.read.parquet(f"{path}/manifests"), staged(_manifests(spark, path), "manifests")
    if not found.exceptAll(stored).unionAll(stored.exceptAll(found)).isEmpty():
        raise ValueError("a manifest doesn't fit its documents")
    unstage(found)
    top = spark.read.parquet(f"{path}/top").collect()
    if [(r["documents"], r["tokens"], bytes(r["root"])) for r in top] != [_top(stored)]:
        raise ValueError("the manifests don't fit the store's root")
    of, names = _result("ids" if with_ids else "digest"), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))[: len(names)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    packs = spark.read.parquet(f"{path}/packs")
    partly = F.locate(chr(FOREIGN), F.decode("states", "ISO-8859-1")) > 0

    def rebuilt(doc: int | None, start: int, n: int, own: bytes, digests: list, lengths: list, states: bytes, root: bytes, found: dict) -> bytes:
        mine, at, out = unpacked(own).tobytes(), 0, []
        for k, (d, length, state) in enumerate(zip(digests, lengths, states, strict=True)):
            if state == FOREIGN:
                chunk = found[k]
            else:
                chunk = mine[at : at + 4 * length]
                at += 4 * length
            if address(chunk) != d:
                raise ValueError("a chunk doesn't have its digest")
            out.append(chunk)
        ids = b"".join(out)
        if leaf(doc, start, n, merkle(digests)) != root or len(ids) != 4 * n:
            raise ValueError("a document doesn't fit its root")
        return ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(doc, start, *of(rebuilt(doc, start, *rest, {}))) for doc, start, *rest in zip(*(listed(b.column(i)) for i in range(8)), strict=True)])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, digests, lengths, states in zip(*(listed(b.column(i)) for i in range(4)), strict=True):
                data, at = unpacked(own), 0
                for d, n, state in zip(digests, lengths, states, strict=True):
                    if state == SHARED:
                        out.append((d, packed(data[at : at + n])))
                    at += n * (state != FOREIGN)
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["digest", "chunk"])

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        key = None
        for b in batches:
            out = []
            for start, at, chunk, doc, *rest in zip(*(listed(b.column(i)) for i in range(10)), strict=True):
                if key != start:
                    key, found = start, {}
                if at >= 0:
                    found[at] = unpacked(chunk).tobytes()
                else:
                    out.append((doc, start, *of(rebuilt(doc, start, *rest, found))))
            yield batch(out)

    fields = ["doc_id", "start", "n_tokens", "own", "digests", "lengths", "states", "root"]
    whole_docs = packs.where(~partly).select(*fields).mapInArrow(whole, schema)
    stored = packs.where(F.locate(chr(SHARED), F.decode("states", "ISO-8859-1")) > 0).select("own", "digests", "lengths", "states").mapInArrow(shared, "digest binary, chunk binary")
    some = packs.where(partly)
    each = some.select("start", F.posexplode("digests").alias("at", "digest"), "states").where(F.expr(f"substring(states, at + 1, 1) = X'{FOREIGN:02x}'"))
    fetched = each.join(stored, "digest").select("start", "at", "chunk")
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(["doc_id", "n_tokens", "own", "digests", "lengths", "states", "root"], ["long", "long", "binary", "array<binary>", "array<int>", "binary", "binary"], strict=True)]
    # A start is one document's, as every document has at least its end id; the document's row comes after its chunks.
    tagged = fetched.select("start", "at", F.lit(0).alias("last"), "chunk", *none).union(some.select("start", F.lit(-1), F.lit(1), F.lit(None).cast("binary"), "doc_id", "n_tokens", "own", "digests", "lengths", "states", "root"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tagged.repartition(parts, "start").sortWithinPartitions("start", "last").select("start", "at", "chunk", "doc_id", "n_tokens", "own", "digests", "lengths", "states", "root")
    return whole_docs.union(dealt.mapInArrow(resolved, schema))
