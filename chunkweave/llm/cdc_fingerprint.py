"""Document fingerprints from content-defined chunks.

Method. A gear hash with a 32-byte window runs over the UTF-8 bytes. Normalised boundaries: the
stricter mask holds up to the normal chunk size and the looser one from there on, between a
smallest and a largest size, so lengths stay near the normal one and boundaries move with the
content when text is inserted or cut. The fingerprint is the set of chunk digests, each weighted
by its chunk's length; the likeness of A to B is the containment: the weight of A's digests that
B also has, over A's weight.

Defined cases. A null text is empty. Empty texts have the empty fingerprint; two empty ones are
alike (1), an empty and another aren't (0). Repeated rows stay; rows are ordered by doc_id
(null first), then text, and "next" is the next row in that order, after the last the first. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, range_of

SMALLEST, NORMAL, LARGEST = 32, 128, 512
#: Leading zero bits that the stricter and the looser mask ask for.
STRICT_BITS, LOOSE_BITS = 9, 5
SEED = 1
_GEAR = np.random.default_rng(SEED).integers(0, 2**32, 256, np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # the hash of 2 * width bytes from those of width bytes
        if n > width:
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint32(width)
            h = longer
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = loose[h[loose] < np.uint32(1 << (32 - STRICT_BITS))].tolist()
    loose = loose.tolist()
    out, start = [], 0
    while n - start > SMALLEST:
        i = bisect_left(strict, start + SMALLEST - 1)
        if i < len(strict) and strict[i] < start + NORMAL:
            end = strict[i] + 1
        else:
            i = bisect_left(loose, start + NORMAL)
            end = min(loose[i] + 1 if i < len(loose) else n, start + LARGEST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_set(text: str) -> dict[int, int]:
    """Length of each chunk digest of the text."""
    data, start, out = text.encode(), 0, {}
    for end in cuts(data) if data else []:
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of a in b by length, 0 to 1."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def spelled(chunks: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of docs(doc_id, text); nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spelled(chunk_set(t or "")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and the next row's.

    Rows are dealt to ranges of doc_id by boundaries that are at most as many as the shuffle's
    partitions, and each range also gets the first row of the next one that isn't empty: one
    shuffle of the texts, and no global order is built in a task. Rows of one doc_id, and those
    without one, are one range each, as their order among themselves is by text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(lowest))
    bounds = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("b")).first()["b"] or []
    bucket = range_of(key, sorted(set(bounds)))  # at most one bound less than the partitions
    keyed = rows.select(bucket.alias("bucket"), key.alias("k"), "doc_id", "text")
    firsts = {r["bucket"]: r["k"] for r in keyed.groupBy("bucket").agg(F.min("k").alias("k")).collect()}  # one row for each range
    follows = [(b, firsts[min((x for x in firsts if x > b), default=min(firsts))]) for b in firsts]
    after = spark.createDataFrame(follows, "bucket int, k long")
    heads = keyed.where(F.col("k").isin([k for _, k in follows])).groupBy("k").agg(F.min("text").alias("text"))
    ghosts = heads.join(F.broadcast(after), "k").select("bucket", F.lit(True).alias("ghost"), "k", F.lit(None).cast("long").alias("doc_id"), "text")
    dealt = keyed.select("bucket", F.lit(False).alias("ghost"), "k", "doc_id", "text").union(ghosts)
    dealt = dealt.repartition(max(parts, 1), "bucket").sortWithinPartitions("bucket", "ghost", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        names = [c.split()[0] for c in _OUT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for b in batches:
            out: list[tuple] = []
            for bucket, ghost, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                chunks = chunk_set(text)
                if last is not None and last[0] == bucket:
                    _, ended, before, own = last
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = chunk_set(edited)
                    out.append((ended, len(before), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(changed), likeness(own, changed), likeness(own, chunks)))
                last = None if ghost else (bucket, doc, text, chunks)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return dealt.select("bucket", "ghost", "doc_id", "text").mapInArrow(run, _OUT)
