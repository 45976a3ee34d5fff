"""Substring deduplication by factors that are copied from earlier documents.

Method. Every document is cut into factors that are copied from documents with smaller ids and
words that are not. Windows are matched exactly, in place of a greedy parse against each block;
the README says why. The reference is the whole corpus, cut into index blocks by anchors: the anchor of a 13-word window is its 6-word run with the smallest hash, so equal
windows have equal anchors at equal offsets, and neighbouring windows mostly share one anchor.
A block gets, for each anchor occurrence, the anchor's hash once and 32 bits for each window
around it, and answers with the matches: the window run and where the smallest document has it.
96 bits tell windows of different slices apart, and 64 bits those of one slice. A document's matches are joined greedily into maximal factors along
one reference; windows across a factor's boundary have matches of their own, from whatever
reference has them. A factor is at least one window long, and its words are the duplicate span.

Skew. A passage in a third of all documents is settled within each input slice first: only the
slice's smallest document asks the index, so a block gets one entry for each slice and passage.
Texts are shuffled once, with their matches, and parsed in a stream.

Defined cases. Null texts have no words. A null doc_id is neither a reference nor parsed; its row
stays whole. Rows of one doc_id don't remove each other. Empty tables give empty results; extra
columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, word_hashes

WINDOW, ANCHOR = 13, 6
#: Windows of one input slice; bounds a worker's memory to about 100 MB.
SLICE = 1_000_000
#: Input of one index block, most blocks, and the estimate from which on the planner doesn't know the size.
BLOCK_BYTES, BLOCKS_MOST, UNKNOWN_BYTES = 16 << 20, 1 << 17, 1 << 50
_SPAN = np.dtype([("at", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("ref_at", "<i4")])
_MULT = np.random.default_rng(3).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; length len(h) - n + 1."""
    m = len(h) - n + 1
    out = h[:m] * _MULT[0]
    for j in range(1, n):
        out += h[j : j + m] * _MULT[j]
    return _mixed(out)


def _lowest(a: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of each `width` neighbours."""
    idx, val, have = np.arange(len(a)), a, 1
    while have < width:
        step = min(have, width - have)
        m = len(val) - step
        right = val[step : step + m] < val[:m]
        idx, val = np.where(right, idx[step : step + m], idx[:m]), np.where(right, val[step : step + m], val[:m])
        have += step
    return idx


def _runs(*same: np.ndarray) -> np.ndarray:
    """Starts of the runs in which each array stays."""
    new = np.ones(len(same[0]), bool)
    if len(new):
        new[1:] = False
        for a in same:
            new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _spans(doc: np.ndarray, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched windows in (doc, at) order as runs along one reference: documents and spans."""
    line = np.arange(len(at))
    first = _runs(doc, at - line, ref, ref_at - line)
    out = np.empty(len(first), _SPAN)
    out["at"], out["n"], out["ref"], out["ref_at"] = at[first], np.diff(np.append(first, len(at))), ref[first], ref_at[first]
    return doc[first], out


def index_slice(ids: np.ndarray, marks: np.ndarray, hashes: list[np.ndarray], blocks: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, bytes]]]:
    """Index entries by block, and the matches that the slice settles itself as (doc_id, mark, spans)."""
    order = np.argsort(ids, kind="stable")
    ids, marks, hashes = ids[order], marks[order], [hashes[i] for i in order]
    sizes = np.array([len(h) for h in hashes])
    if not len(sizes) or sizes.max() < WINDOW:
        return [], []
    h = np.concatenate(hashes)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - WINDOW + 1, 0))  # of each window
    w = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(np.maximum(sizes - WINDOW + 1, 0)) - np.maximum(sizes - WINDOW + 1, 0)), np.maximum(sizes - WINDOW + 1, 0))
    anchors = _grams(h, ANCHOR)
    near = _lowest(anchors, WINDOW - ANCHOR + 1)[w]  # place of each window's anchor
    whole = _grams(h, WINDOW)[w]

    by = np.argsort(whole)
    group = _runs(whole[by])
    owner = np.empty(len(by), np.int64)
    owner[by] = np.repeat(np.minimum.reduceat(by, group), np.diff(np.append(group, len(by))))
    settled = ids[doc] > ids[doc[owner]]
    at = w - starts[doc]
    own: list[tuple[int, int, bytes]] = []
    if settled.any():
        s = np.flatnonzero(settled)
        d, spans = _spans(doc[s], at[s], ids[doc[owner[s]]], at[owner[s]])
        cut = _runs(d)
        for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True):
            own.append((int(ids[d[a]]), int(marks[d[a]]), spans[a:b].tobytes()))

    u = np.flatnonzero(~settled)
    first = _runs(near[u], u - np.arange(len(u)))  # an anchor's windows that follow each other
    count = np.diff(np.append(first, len(u)))
    f = u[first]
    hashed, place, of = anchors[near[f]], (near[f] - starts[doc[f]]).astype("<i4"), doc[f]
    shape = ((near[f] - w[f]) << 4 | count).astype(np.uint8)
    tail = (whole[u] & np.uint64(0xFFFFFFFF)).astype("<u4")
    block = (hashed % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    entries = []
    cut = _runs(block[by])
    for a, b in zip(cut, np.append(cut[1:], len(by)), strict=True):
        e = by[a:b]  # ascending, so documents stay together
        docs = _runs(of[e])
        pick = np.repeat(first[e] - (np.cumsum(count[e]) - count[e]), count[e]) + np.arange(count[e].sum())
        head = np.array([len(docs), len(e), len(pick)], "<i8")
        parts = (head, ids[of[e[docs]]].astype("<i8"), marks[of[e[docs]]].astype("<i8"), np.diff(np.append(docs, len(e))).astype("<i8"), hashed[e].astype("<u8"), place[e], shape[e], tail[pick])
        entries.append((int(block[e[0]]), b"".join(p.tobytes() for p in parts)))
    return entries, own


def _entries(blob: bytes) -> tuple[np.ndarray, ...]:
    nd, na, nw = np.frombuffer(blob, "<i8", 3).tolist()
    out, at = [], 24
    for kind, n in (("<i8", nd), ("<i8", nd), ("<i8", nd), ("<u8", na), ("<i4", na), ("u1", na), ("<u4", nw)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ids, marks, many, hashed, place, shape, tail = out
    return np.repeat(ids, many), np.repeat(marks, many), hashed, place.astype(np.int64), shape.astype(np.int64), tail


def match_block(blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Matches that the entries of one or more blocks have with each other, as (doc_id, mark, spans)."""
    if not blobs:
        return []
    ids, marks, hashed, place, shape, tail = (np.concatenate(x) for x in zip(*map(_entries, blobs), strict=True))
    count = shape & 15
    start = np.cumsum(count) - count
    by = np.argsort(hashed)
    group = _runs(hashed[by])
    size = np.diff(np.append(group, len(by)))
    e = by[np.repeat(size > 1, size)]
    if not len(e):
        return []
    many = count[e]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    off = np.repeat(shape[e] >> 4, many) - nth  # the anchor's place in the window
    key1, key2 = np.repeat(hashed[e], many), (off.astype(np.uint64) << np.uint64(32)) | tail[np.repeat(start[e], many) + nth]
    doc, mark, at = np.repeat(ids[e], many), np.repeat(marks[e], many), np.repeat(place[e], many) - off
    by = np.lexsort((at, doc, key2, key1))
    group = _runs(key1[by], key2[by])
    owner = np.repeat(by[group], np.diff(np.append(group, len(by))))
    hit = doc[by] > doc[owner]
    by, owner = by[hit], owner[hit]
    if not len(by):
        return []
    again = np.lexsort((at[by], mark[by], doc[by]))
    by, owner = by[again], owner[again]
    both = _runs(doc[by], mark[by])
    nr = np.repeat(np.arange(len(both)), np.diff(np.append(both, len(by))))
    d, spans = _spans(nr, at[by], doc[owner], at[owner])
    cut = _runs(d)
    return [(int(doc[by[both[d[a]]]]), int(mark[by[both[d[a]]]]), spans[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True)]


def parse(spans: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, reference document, its first word) from a document's matches."""
    spans = np.sort(spans, order=["at", "n"])
    out: list[list[int]] = []
    for at, n, ref, ref_at in spans.tolist():
        if out and out[-1][2] == ref and out[-1][3] - out[-1][0] == ref_at - at and at <= out[-1][0] + out[-1][1] - WINDOW + 1:
            out[-1][1] = max(out[-1][1], at - out[-1][0] + n + WINDOW - 1)
        else:
            out.append([at, n + WINDOW - 1, ref, ref_at])
    return [tuple(x) for x in out]


def blocks_of(docs: DataFrame) -> int:
    """Index blocks by the planner's estimate of the input's size, so that a block's entries fit a worker however large the input is."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts, min(-(-size // BLOCK_BYTES), BLOCKS_MOST)) if size < UNKNOWN_BYTES else parts


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): window runs that a document with a smaller id also has; mark: a hash of the row's text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = blocks_of(docs)
    schema = "block int, entries binary, doc_id long, mark long, spans binary"
    names = ["block", "entries", "doc_id", "mark", "spans"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        marks: list[int] = []
        hashes: list[np.ndarray] = []
        total, turn, known = 0, 0, word_hashes()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, turn
            entries, own = index_slice(np.array(ids, np.int64), np.array(marks, np.int64), hashes, blocks)
            ids.clear(), marks.clear(), hashes.clear()
            total = 0
            for at in range(0, len(entries), 16):
                k, blob = zip(*entries[at : at + 16], strict=True)
                none = [None] * len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(blob, pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names)
            for at in range(0, len(own), 4096):
                d, m, s = zip(*own[at : at + 4096], strict=True)
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array([(turn + i) % blocks for i in range(len(d))], pa.int32()), pa.array([None] * len(d), pa.binary()), pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.binary())], names)

        for b in batches:
            for doc, mark, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.split() if text else []
                if len(words) < WINDOW:
                    continue
                ids.append(doc)
                marks.append(mark)
                hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                total += len(words)
                if total >= SLICE:
                    yield from flush()
        yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []

        def said(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 4096):
                d, m, s = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.binary())], names[2:])

        for b in batches:
            blobs += [x for x in b.column(1).to_pylist() if x is not None]
            keep = b.column(2).is_valid()
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (2, 3, 4)], names[2:])
        yield from said(match_block(blobs))

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").cast("long").alias("mark"), F.encode("text", "UTF-8").alias("b"))
    return rows.mapInArrow(index, schema).repartition(blocks, "block").mapInArrow(answer, "doc_id long, mark long, spans binary")


def _parsed(docs: DataFrame, schema: str, of, carry: list[str] | None = None) -> DataFrame:
    """of(text, words, spans) for every row, beside the columns to carry; schema starts with doc_id long."""
    carry = carry or []
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.hash("text"), F.lit(0)).cast("long").alias("mark"), F.lit(1).alias("kind"), F.encode("text", "UTF-8").alias("b"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    types = [docs.schema[c].dataType for c in carry]
    found = matches(docs).select("doc_id", "mark", F.lit(0).alias("kind"), F.col("spans").alias("b"), *(F.lit(None).cast(t).alias(f"_{i}") for i, t in enumerate(types)))
    dealt = found.union(texts).repartition(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "kind")
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    none = np.empty(0, _SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have = None, []
        for b in batches:
            out: list[tuple] = []
            own = b.column(2).to_numpy() == 1
            carried = [b.column(4 + i).filter(pa.array(own)) for i in range(len(carry))]
            for doc, mark, kind, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != (doc, mark):
                    key, have = (doc, mark), []
                if not kind:
                    have.append(data)
                else:
                    spans = np.frombuffer(b"".join(have), _SPAN) if have and doc is not None else none
                    out.append((doc, *of(data or b"", (data or b"").split(), spans)))
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)), *carried], [*(n for n, _ in fields), *(f"_{i}" for i in range(len(carry)))])

    more = "".join(f", _{i} {t.simpleString()}" for i, t in enumerate(types))
    out = dealt.mapInArrow(run, schema + more)
    return out.select(*(n for n, _ in fields), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def covered(n: int, factors: list[tuple[int, int, int, int]]) -> np.ndarray:
    gone = np.zeros(n, bool)
    for at, words, _, _ in factors:
        gone[at : at + words] = True
    return gone


def _digest(text: bytes, words: list[bytes], spans: np.ndarray) -> tuple:
    gone = covered(len(words), parse(spans))
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _kept(text: bytes, words: list[bytes], spans: np.ndarray) -> tuple:
    if not len(spans):
        return len(words), 0, text.decode(), ""
    factors = parse(spans)
    gone = covered(len(words), factors).tolist()
    said = ";".join(",".join(map(str, f)) for f in factors)
    return len(words), sum(gone), b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode(), said


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs(doc_id, text)."""
    return _parsed(docs, "doc_id long, n_words long, n_removed long, kept_sha256 string", _digest)


def deduplicated(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text, factors, *carry) for every row; untouched texts stay as they are.

    factors: `first word,words,reference document,its first word`, joined by semicolons.
    """
    return _parsed(docs, "doc_id long, n_words long, n_removed long, text string, factors string", _kept, carry)
