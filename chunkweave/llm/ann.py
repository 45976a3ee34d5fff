"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Method. Equal vectors are one node. Every node starts with the best of a few random others.
NN-descent then improves the lists in rounds of Spark joins: a node draws SAMPLE of its new and
SAMPLE of its old neighbours and tells them; a host's members are its drawn neighbours and up to
SAMPLE new and old ones that drew it; a host's block asks for its members' vectors by a join;
each new member is compared with all members there, and what beats a member's worst neighbour goes
to that member's list. Rounds end when less than STILL of all list entries have changed. A search
keeps a beam of the best nodes of each query. A hop asks each shard to expand the beam's new nodes
there and to score nodes that other shards have found; a shard scores its own finds at once and
goes on from the best of them, up to its share of the beam. The query merges the answers, until no
beam has a new node and nothing found is unscored.

Scale. A block is a cell of random hyperplanes with about BLOCK nodes, so a node's hosts tend to
share blocks and their number grows with the data. A vector goes once to each block that asks for
it, at most as often as its node is drawn. Lists are made with vectors divided by their largest
component, in float16 beside that component over the largest of all, so any magnitude will do;
a search scores with the vectors themselves, in double precision.

Skew. A vector that a third of all rows have is one node, with its nodes' k + 1 smallest ids (more
cannot be in a result). Of those that draw a node that very many have, each task sends on up to
SAMPLE, and the host keeps as many; this draw is NN-descent's own.

Defined cases. Vectors that are null, zero, or hold null or non-finite components, and those not of
the most frequent length (the smaller of equally frequent ones), take no part; nor does a null
vec_id. Equal rows are one candidate. Fewer candidates than k: all that are found. Ties go to the
smaller id. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, released, staged, unstage

#: Neighbours of a node, new and old ones drawn in a round, random others to start from (twice), share of changed entries that ends the rounds.
DEGREE, SAMPLE, START, STILL = 32, 16, 64, 0.03
#: Nodes of a block and of a shard of the search; beam of a query.
BLOCK, SHARD, BEAM = 256, 4096, 192
#: Low bits of a node that number it within its block.
NUMBER = 24
SEED = 4
_LISTS = "node long, ids binary, sims binary, news binary, fresh long, worst float, small binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _batches(rows: list[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield _batch(rows[at : at + size], schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted stream by their first columns."""
    key, have = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if have and row[:keys] != key:
                yield key, have
                have = []
            key = row[:keys]
            have.append(row[keys:])
    if have:
        yield key, have


def _short(x: np.ndarray) -> list[bytes]:
    """Rows of x, whose components are at most 1, as their largest magnitude in float32 and, divided by it, in float16."""
    scale = np.maximum(np.abs(x).max(1, initial=0), np.finfo(np.float32).tiny).astype("<f4")
    halves = (x / scale[:, None].astype(np.float64)).astype("<f2")
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, halves, strict=True)]


def _matrix(vecs: list[bytes]) -> np.ndarray:
    """Rows of _short() in float32."""
    raw = np.frombuffer(b"".join(vecs), "u1").reshape(len(vecs), -1)
    return np.ascontiguousarray(raw[:, 4:]).view("<f2").astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def vectors(table: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, vec) of the rows of table(vec_id, embedding) that take part, and the numbers' type."""
    bounded_batches(table.sparkSession)
    kind = "<f4" if "float" in table.schema["embedding"].dataType.simpleString() else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if v.values.null_count == 0 and np.isfinite(x).all() and x.any():
                    out.append((vec_id, (x + 0).astype(kind).tobytes()))
            yield _batch(out, "vec_id long, vec binary")

    rows = table.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec binary")
    rows = staged(rows, "vectors")
    widths = rows.groupBy(F.octet_length("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.octet_length("vec") == (widths["w"] if widths else 0)), kind


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): distinct vectors, each with its k + 1 smallest ids."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("n", nth).where(F.col("n") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _nth(*keys: np.ndarray) -> np.ndarray:
    """Place of each entry within the run of equal keys that it stands in."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    line = np.arange(n)
    return line - np.maximum.accumulate(np.where(new, line, 0)) if n else line


def _cut(key: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(_nth(key) == 0)
    return starts.tolist(), np.append(starts[1:], len(key)).tolist() if len(starts) else []


def spread(rows: DataFrame, kind: str) -> tuple[float, list[float]]:
    """Largest magnitude of a component, and the mean vector divided by it; one row for each partition comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, total = 0, 0.0, np.zeros(0)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(b.num_rows, -1).astype(np.float64)
            here = max(most, float(np.abs(x).max()))
            total = (x / here).sum(0) + (total * (most / here) if n else 0)
            n, most = n + b.num_rows, here
        if n:
            yield _batch([(n, most, total.astype("<f8").tobytes())], "n long, most double, total binary")

    found = rows.select("vec").mapInArrow(run, "n long, most double, total binary").collect()
    if not found:
        return 1.0, []
    most = max(r["most"] for r in found)
    total = sum(np.frombuffer(r["total"], "<f8") * (r["most"] / most) for r in found)
    return most, (total / sum(r["n"] for r in found)).tolist()


def numbered(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """(node, vec, small, ids): node is `block << NUMBER | number`, small the vector over the largest magnitude, see _short().

    A block is a cell of random hyperplanes through the mean vector; a cell of over BLOCK nodes is
    several blocks. Hosts with a block in common are compared in one place.
    """
    most, mean = spread(rows, kind)
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((len(mean), bits))
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(b.num_rows, len(mean) or 1).astype(np.float64) / most
            code = ((x - mean) @ planes > 0) @ (1 << np.arange(bits)) if b.num_rows and bits else np.zeros(b.num_rows, np.int64)
            small = _short(x)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), b.column(0), pa.array(small, pa.binary()), b.column(1)], ["cell", "vec", "small", "ids"])

    celled = staged(rows.select("vec", "ids").mapInArrow(cells, "cell long, vec binary, small binary, ids array<long>"), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("vec"), F.col("parts"))
    placed = celled.join(sizes, "cell").withColumn("block", F.shiftrightunsigned(F.xxhash64("cell", part), NUMBER + 1))
    number = F.row_number().over(Window.partitionBy("block").orderBy(F.col("ids")[0]))
    return placed.select((F.shiftleft("block", NUMBER) + number).alias("node"), "vec", "small", "ids")


def _block(node: Column | str) -> Column:
    return F.shiftright(F.col(node) if isinstance(node, str) else node, NUMBER)


_PACKED = "block long, old boolean, nodes binary, sizes binary, ids binary, sims binary, news binary"
_KINDS = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _messages(nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, news: np.ndarray, old: bool) -> pa.RecordBatch:
    """Entries (node, id, sim, new) as one row for each block of nodes."""
    order = np.argsort(nodes, kind="stable")
    nodes, ids, sims, news = nodes[order], ids[order], sims[order], news[order]
    to, rows = nodes >> NUMBER, []
    for at, end in zip(*_cut(to), strict=True):
        each, sizes = np.unique(nodes[at:end], return_counts=True)
        rows.append((int(to[at]), old, each.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), ids[at:end].astype("<i8").tobytes(), sims[at:end].astype("<f4").tobytes(), news[at:end].astype("u1").tobytes()))
    cols = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], ["block", "old", "nodes", "sizes", "ids", "sims", "news"])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Entries (node, id, sim, new) of a batch of lists(node, ids, sims, news)."""
    ids, sims, news = ([np.frombuffer(x, kind) for x in b.column(i).to_pylist()] for i, kind in ((1, "<i8"), (2, "<f4"), (3, "u1")))
    nodes = np.repeat(b.column(0).to_numpy(), [len(x) for x in ids]).astype(np.int64)
    return nodes, np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*sims, np.zeros(0, np.float32)]), np.concatenate([*news, np.zeros(0, np.uint8)]).astype(bool)


def _few(nodes: np.ndarray, others: np.ndarray, news: np.ndarray, turn: int) -> np.ndarray:
    """Mask of up to SAMPLE new and SAMPLE old entries of each node: the same ones whenever it is asked."""
    lot = _mixed(_mixed(nodes) ^ others.astype(np.uint64) ^ np.uint64(turn << 50))
    order = np.lexsort((lot, news, nodes))
    out = np.zeros(len(nodes), bool)
    out[order[_nth(nodes[order], news[order]) < SAMPLE]] = True
    return out


def _carried(small: DataFrame) -> DataFrame:
    """The vectors of small(node, small) as messages to the lists: `old` is null, `ids` the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vecs = b.column(0).to_numpy(), b.column(1).to_pylist()
            order = np.argsort(nodes, kind="stable")
            nodes, rows = nodes[order], []
            for at, end in zip(*_cut(nodes >> NUMBER), strict=True):
                rows.append((int(nodes[at] >> NUMBER), None, nodes[at:end].astype("<i8").tobytes(), None, b"".join([vecs[i] for i in order[at:end].tolist()]), None, None))
            cols = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], [f.split()[0] for f in _PACKED.split(", ")])

    return small.select("node", "small").mapInArrow(run, _PACKED)


def _merged(messages: DataFrame, small: DataFrame, tag: str) -> DataFrame:
    """One list of every node that a message is for: (node, ids, sims, news, fresh, worst, small), fresh being how many ids no `old` message had."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        vec: dict[int, bytes] = {}
        for r in rows:
            if r[0] is None:
                nodes, width = np.frombuffer(r[1], "<i8").tolist(), 8 * len(r[3]) // len(r[1])
                vec.update((x, r[3][width * i : width * (i + 1)]) for i, x in enumerate(nodes))
        rows = [r for r in rows if r[0] is not None]
        if not rows:
            return
        node = np.concatenate([np.repeat(np.frombuffer(r[1], "<i8"), np.frombuffer(r[2], "<i4")) for r in rows])
        ids, sims, news = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((3, "<i8"), (4, "<f4"), (5, "u1")))
        old = np.repeat([r[0] for r in rows], [len(r[3]) // 8 for r in rows])
        order = np.lexsort((~old, ids, node))  # an entry that was there before comes before its repeats
        node, ids, sims, news, old = (x[order] for x in (node, ids, sims, news, old))
        keep = (_nth(node, ids) == 0) & (ids != node)
        node, ids, sims, news, old = (x[keep] for x in (node, ids, sims, news, old))
        order = np.lexsort((ids, -sims, node))
        node, ids, sims, news, old = (x[order] for x in (node, ids, sims, news, old))
        out = []
        for at, end in zip(*_cut(node), strict=True):
            end = min(end, at + DEGREE)
            out.append((int(node[at]), ids[at:end].tobytes(), sims[at:end].tobytes(), news[at:end].tobytes(), int((~old[at:end]).sum()), float(sims[end - 1]) if end - at >= DEGREE else -np.inf, vec[int(node[at])]))
        yield from _batches(out, _LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            yield from fold(rows)

    return staged(messages.unionByName(_carried(small)).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, _LISTS), tag)


def first_lists(nodes: DataFrame) -> DataFrame:
    """Every node's best of up to 2 x START random others: START of its own block, START of a group that a hash deals."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-nodes.count() // BLOCK))
    dealt = nodes.select(F.explode(F.array(_block("node"), F.pmod(F.xxhash64("node"), F.lit(groups)) - groups)).alias("g"), "node", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g,), rows in _groups(batches, 1):
            rows = sorted(rows)
            ids, x = np.array([r[0] for r in rows]), _matrix([r[1] for r in rows])
            if len(ids) < 2:
                continue
            steps = 1 + np.random.default_rng([SEED, g & (2**63 - 1)]).permutation(len(ids) - 1)[:START]
            other = (np.arange(len(ids))[:, None] + steps) % len(ids)
            sims = np.concatenate([np.einsum("nd,nkd->nk", x[a : a + 256], x[other[a : a + 256]]) for a in range(0, len(ids), 256)])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :DEGREE]
            own, other, sims = np.repeat(ids, best.shape[1]), ids[np.take_along_axis(other, best, 1)].ravel(), np.take_along_axis(sims, best, 1).ravel()
            yield _messages(own, other, sims, np.ones(len(own), bool), False)

    sent = dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, _PACKED)
    return _merged(sent, nodes, "graph")


_HOSTS = "block long, hosts binary, sizes binary, members binary, news binary"


def _hosts(graph: DataFrame, turn: int) -> DataFrame:
    """One row for each block: its hosts and their members, `news` telling the new ones."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other, _, new = _flat(b)
            few = _few(own, other, new, turn)
            own, other, new = own[few], other[few], new[few]
            # Of those here that drew the same node a host needs no more than it can keep.
            lot = _mixed(_mixed(other) ^ own.astype(np.uint64) ^ np.uint64(turn << 50))
            order = np.lexsort((lot, new, other))
            back = order[_nth(other[order], new[order]) < SAMPLE]
            none = np.zeros(len(own), np.float32)
            yield _messages(own, other, none, new, False)
            yield _messages(other[back], own[back], none[: len(back)], new[back], True)  # old: told by the other one

    sent = graph.select("node", "ids", "sims", "news").mapInArrow(drawn, _PACKED)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in _groups(batches, 1):
            host = np.concatenate([np.repeat(np.frombuffer(r[1], "<i8"), np.frombuffer(r[2], "<i4")) for r in rows])
            member, new = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows]), np.concatenate([np.frombuffer(r[5], "u1") for r in rows]).astype(bool)
            told = np.repeat([r[0] for r in rows], [len(r[3]) // 8 for r in rows])
            lot = _mixed(_mixed(host) ^ member.astype(np.uint64) ^ np.uint64(turn << 50))
            order = np.lexsort((lot, new, told, host))
            host, member, new, told = host[order], member[order], new[order], told[order]
            keep = (_nth(host, told, new) < SAMPLE) | ~told
            host, member, new = host[keep], member[keep], new[keep]
            order = np.lexsort((~new, member, host))
            host, member, new = host[order], member[order], new[order]
            keep = _nth(host, member) == 0
            host, member, new = host[keep], member[keep], new[keep]
            each, sizes = np.unique(host, return_counts=True)
            row = (block, each.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), member.astype("<i8").tobytes(), new.astype("u1").tobytes())
            yield _batch([row], _HOSTS)

    return staged(sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(gather, _HOSTS), "hosts")


def _compared(hosts: DataFrame, graph: DataFrame) -> DataFrame:
    """Messages of candidates from comparing each host's new members with all of its members."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                each = np.unique(np.frombuffer(members, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.full(len(each), block, np.int64))], ["node", "block"])

    wanted = hosts.select("block", "members").mapInArrow(asked, "node long, block long")
    held = graph.select("node", "small", "worst")
    body = ["hosts", "sizes", "members", "news"]
    vecs = wanted.join(held, "node").select("block", F.lit(0).alias("last"), "node", "small", "worst", *(F.lit(None).cast("binary").alias(c) for c in body))
    plans = hosts.select("block", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("float"), *body)
    sent = vecs.union(plans).repartition(parts, "block").sortWithinPartitions("block", "last")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            rows = sorted(rows, key=lambda r: (r[0], r[1] or 0))
            _, _, _, _, _, sizes, members, news = rows.pop()
            ids, x, worst = np.array([r[1] for r in rows]), _matrix([r[2] for r in rows]), np.array([r[3] for r in rows], np.float32)
            at, new = np.searchsorted(ids, np.frombuffer(members, "<i8")), np.frombuffer(news, "u1").astype(bool)
            ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
            found: list[tuple] = []
            for start, end in zip([0, *ends], ends, strict=False):
                m = at[start:end]
                a = m[new[start:end]]
                if len(a):
                    s = x[a] @ x[m].T
                    i, j = np.nonzero(s > np.minimum(worst[a][:, None], worst[m]))
                    found.append((a[i], m[j], s[i, j]))
            if not found:
                continue
            a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
            i, j, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
            keep = (i != j) & (s > worst[i])
            i, j, s = i[keep], j[keep], s[keep]
            keep = np.unique(i * len(ids) + j, return_index=True)[1]  # a pair that met at several hosts
            i, j, s = i[keep], j[keep], s[keep]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            # DEGREE of 2 x DEGREE different ones aren't there yet, so no later one can enter the list
            keep = _nth(i) < 2 * DEGREE
            yield _messages(ids[i[keep]], ids[j[keep]], s[keep], np.ones(int(keep.sum()), bool), False)

    return sent.mapInArrow(compare, _PACKED)


def _standing(graph: DataFrame, turn: int) -> DataFrame:
    """The lists as messages to themselves; what was drawn in this round is no longer new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other, sims, new = _flat(b)
            yield _messages(own, other, sims, new & ~_few(own, other, new, turn), True)

    return graph.select("node", "ids", "sims", "news").mapInArrow(run, _PACKED)


def neighbour_graph(nodes: DataFrame, n: int) -> DataFrame:
    """(node, ids, sims, ...): lists of up to DEGREE neighbours, best first."""
    small = nodes.select("node", "small")
    graph, turn = first_lists(nodes.select("node", "small")), 0
    while True:
        hosts = _hosts(graph, turn)
        nxt = _merged(_standing(graph, turn).unionByName(_compared(hosts, graph)), small, "graph")
        unstage(hosts)
        unstage(graph)
        released(small.sparkSession)
        graph, turn = nxt, turn + 1
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= STILL * n * DEGREE:
            return graph


def _adjacency(graph: DataFrame) -> DataFrame:
    """(node, ids): neighbours in both directions, of those towards a node the DEGREE nearest."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            own = np.repeat(b.column(0).to_numpy(), [len(x) for x in lists])
            sims = np.concatenate([*(np.frombuffer(x, "<f4") for x in b.column(2).to_pylist()), np.zeros(0, np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])), pa.array(own), pa.array(sims)], ["node", "other", "sim"])

    edges = graph.select("node", "ids", "sims").mapInArrow(back, "node long, other long, sim float")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    near = edges.withColumn("n", nth).where(F.col("n") <= DEGREE).groupBy("node").agg(F.collect_list("other").alias("back"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(v, np.union1d(np.frombuffer(i, "<i8"), np.array(o or (), np.int64)).astype("<i8").tobytes()) for v, i, o in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)], "node long, ids binary")

    return graph.join(near, "node", "left").select("node", "ids", "back").mapInArrow(both, "node long, ids binary")


def _shard(node: Column | str, shards: int) -> Column:
    """Shard of a node in the search: whole blocks, about SHARD nodes."""
    return (_block(node) % shards).cast("int")


def _better(ids: np.ndarray, sims: np.ndarray, bar: float, edge: int) -> np.ndarray:
    """Which entries come before (bar, edge) in a beam."""
    return (sims > bar) | ((sims == bar) & (ids < edge))


class _Held:
    """A shard's nodes, their vectors and links."""

    def __init__(self, shard: int, rows: list[tuple], kind: str) -> None:
        rows.sort()
        self.shard, self.ids = shard, np.array([r[0] for r in rows], np.int64)
        self.x = np.frombuffer(b"".join([r[1] for r in rows]), kind).reshape(len(rows), -1)
        self.links = [r[2] or b"" for r in rows]

    def visit(self, vec: np.ndarray, bar: float, edge: int, known: np.ndarray, expand: np.ndarray, asked: np.ndarray, shards: int, beam: int) -> tuple:
        """(ids, sims, which are expanded, nodes of other shards that were found).

        Expands `expand`, scores `asked` and what is found here, and goes on from the best of them
        here, up to a shard's share of the beam; what is not expanded here the query asks for later.
        """
        at = lambda nodes: np.searchsorted(self.ids, nodes)
        seen, expanded = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        seen[at(known)] = True
        todo, front, left = at(asked), at(expand), max(1, beam // shards)
        todo = todo[~seen[todo]]
        seen[todo] = True
        have, sims, away = np.zeros(0, np.int64), np.zeros(0), [np.zeros(0, np.int64)]
        while True:
            if len(front):
                found = np.unique(np.frombuffer(b"".join([self.links[i] for i in front.tolist()]), "<i8"))
                here = (found >> NUMBER) % shards == self.shard
                away.append(found[~here])
                found = at(found[here])
                todo = np.append(todo, found[~seen[found]])
                seen[todo] = True
            if len(todo):
                near = self.x[todo].astype(np.float64) @ vec
                keep = _better(self.ids[todo], near, bar, edge)
                have, sims, todo = np.append(have, todo[keep]), np.append(sims, near[keep]), todo[:0]
                best = np.lexsort((self.ids[have], -sims))[:beam]
                have, sims = have[best], sims[best]
            front = have[~expanded[have]][: min(left, max(1, beam // 8))]
            if not len(front):
                return self.ids[have], sims, expanded[have], np.unique(np.concatenate(away))
            expanded[front] = True
            left -= len(front)


_STATE = "query long, vec binary, ids binary, sims binary, expand binary, asked binary"


def _search(nodes: DataFrame, adjacency: DataFrame, queries: DataFrame, kind: str, n: int, k: int) -> DataFrame:
    """(query, ids, sims): the beam of each query(query, vec), whose own node is where it starts.

    A hop is two exchanges: a query asks shards to expand its beam's new nodes and to score nodes
    that other shards have found, and merges the answers.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    beam, shards = max(BEAM, k + 1), max(1, -(-n // SHARD))
    held = staged(nodes.join(adjacency.select("node", F.col("ids").alias("links")), "node", "left").select(_shard("node", shards).alias("shard"), "node", "vec", "links"), "adjacency")
    none = lambda kind: F.lit(None).cast(kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(q, vec, b"", b"", np.array([q], "<i8").tobytes(), b"") for q, vec in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True)], _STATE)

    state = staged(queries.select("query", "vec").mapInArrow(first, _STATE), "beams")
    ask_schema = "shard int, query long, vec binary, bar double, edge long, known binary, expand binary, asked binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for query, vec, *rest in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids, sims, expand, asked = (np.frombuffer(x, t) for x, t in zip(rest, ("<i8", "<f8", "<i8", "<i8"), strict=True))
                bar, edge = (float(sims[-1]), int(ids[-1])) if len(ids) >= beam else (-np.inf, 0)
                lists = [np.append(ids, query), expand, asked]
                to = [(x >> NUMBER) % shards for x in lists]
                for s in np.unique(np.concatenate(to[1:])).tolist():
                    out.append((query, s, vec, bar, edge, *(x[t == s].astype("<i8").tobytes() for x, t in zip(lists, to, strict=True))))
            yield _batch([(s, q, *x) for q, s, *x in out], ask_schema)

    def dealt(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
        """Rows of both in one partition for each key, `mine` first."""
        return mine.union(theirs).repartition(parts, key).sortWithinPartitions(key, "last")

    answer_schema = "query long, ids binary, sims binary, done binary, found binary"

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, here = None, [], None
        for b in batches:
            out: list[tuple] = []
            for s, last, i, vec, links, bar, edge, *lists in zip(*(b.column(j).to_pylist() for j in range(10)), strict=True):
                if s != shard:
                    shard, rows, here = s, [], None
                if not last:
                    rows.append((i, vec, links))
                    continue
                if here is None:
                    here, rows = _Held(s, rows, kind), []
                ids, sims, done, found = here.visit(np.frombuffer(vec, kind).astype(np.float64), bar, edge, *(np.frombuffer(x, "<i8") for x in lists), shards, beam)
                out.append((i, ids.astype("<i8").tobytes(), sims.astype("<f8").tobytes(), done.tobytes(), found.astype("<i8").tobytes()))
            yield _batch(out, answer_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (query,), group in _groups(batches, 1):
            vec = next(g[1] for g in group if not g[0])
            ids, sims, done, found = (np.concatenate([np.frombuffer(g[j] or b"", t) for g in group]) for j, t in ((2, "<i8"), (3, "<f8"), (4, "?"), (5, "<i8")))
            order = np.lexsort((ids, -sims))
            order = order[ids[order] != query][:beam]  # a node is scored in its shard only, and not while it is in the beam
            ids, sims, done = ids[order], sims[order], done[order]
            asked = np.setdiff1d(found, np.append(ids, query))
            out.append((query, vec, ids.tobytes(), sims.tobytes(), ids[~done].tobytes(), asked.tobytes()))
        yield from _batches(out, _STATE)

    busy = (F.octet_length("expand") > 0) | (F.octet_length("asked") > 0)
    # A node is expanded only if it comes before the beam's last; one that has left the beam does not, so beams come to a standstill.
    while not state.where(busy).isEmpty():
        asks = state.where(busy).mapInArrow(ask, ask_schema)
        mine = held.select("shard", F.lit(0).alias("last"), F.col("node").alias("id"), "vec", "links", none("double").alias("bar"), none("long").alias("edge"), *(none("binary").alias(c) for c in ("known", "expand", "asked")))
        theirs = asks.select("shard", F.lit(1), "query", "vec", none("binary"), "bar", "edge", "known", "expand", "asked")
        answers = dealt(mine, theirs, "shard").mapInArrow(visit, answer_schema)
        expanded = F.repeat(F.lit("\x01"), (F.octet_length("ids") / 8).cast("int")).cast("binary")
        sofar = state.select("query", F.lit(0).alias("last"), "vec", "ids", "sims", expanded.alias("done"), none("binary").alias("found"))
        nxt = staged(dealt(sofar, answers.select("query", F.lit(1), none("binary"), "ids", "sims", "done", "found"), "query").mapInArrow(merge, _STATE), "beams")
        unstage(state)
        released(spark)
        state = nxt
    return state.select("query", "ids", "sims")


def nearest(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose vec_id is divisible by `every`."""
    rows, kind = vectors(table)
    each = staged(nodes_of(rows, k), "vectors")
    n = each.count()
    nodes = staged(numbered(each, kind, n), "nodes")
    graph = neighbour_graph(nodes, n)
    asking = staged(rows.where(F.col("vec_id") % every == 0).distinct().join(nodes.select("node", "vec"), "vec").select("vec_id", "node", "vec"), "queries")
    beams = _search(nodes, _adjacency(graph), asking.select(F.col("node").alias("query"), "vec").distinct(), kind, n, k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for query, vec, ids, sims in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                v = np.frombuffer(vec, kind).astype(np.float64)
                i, s = np.frombuffer(ids, "<i8"), np.frombuffer(sims, "<f8")
                keep = i != query
                i, s = np.append(i[keep], query), np.append(s[keep], v @ v)
                order = np.lexsort((i, -s))
                # of equally near ones all that may be in a result, whatever their node's id
                last = s[order[min(k, len(order) - 1)]]
                out += [(query, int(i[o]), float(s[o])) for o in order if s[o] >= last]
            yield _batch(out, "query long, node long, score double")

    starts = asking.select(F.col("node").alias("query"), F.col("vec").alias("v")).distinct()
    top = beams.join(starts, "query").select("query", "v", "ids", "sims").mapInArrow(best, "query long, node long, score double")
    each = top.join(nodes.select("node", F.col("ids").alias("members")), "node").select("query", "score", F.explode("members").alias("vec_id"))
    lists = each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k + 1).alias("near"))
    own = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
    found = own.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
