"""Bulk-synchronous best-fit packing of token runs into sequences of fixed capacity.

Method. Documents are range-sorted by length: a document's rank within its length is worked out
in salted parts plus a prefix sum, so that one frequent length is no hot group. Supersteps then
go down the lengths. In each, the documents of that length and the open gaps meet in successor
sweeps: the smallest gap that is long enough takes documents first, documents of one length
compete by rank, the gaps are updated, and the next superstep begins. Equal lengths and equal
gaps are interchangeable, so a sweep handles a whole class at once: its state is a table of at
most `capacity` lengths and the runs of gaps, however many documents there are, and it runs on
the driver. The sweeps' moves (length, rank range, first sequence, offset) are at most
capacity**2 / 2; the documents join them by length and rank in one distributed step. The result
is that of best-fit decreasing over all documents.

Defined cases. A null text is empty and is the one id `end_id`. Rows may repeat; each is packed.
Lengths outside 1..capacity raise. An empty table gives an empty result. Extra columns are
carried by pack() and ignored by token_pieces().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches, staged

#: Parts in which the documents of one length are ranked, or the shuffle's partitions if those are more; moves that are broadcast.
SALTS, MOVES_MOST = 256, 100_000


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, rank from, rank to, first sequence, offset, documents of each sequence)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    moves, fresh = [], 0
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left = 0, counts[length]
        updated: list[tuple[int, int, int]] = []
        for gap in sorted(g for g in gaps if g >= length):
            each = gap // length
            runs = gaps.pop(gap)
            while runs and left:
                first, many = runs.pop()
                used = min(many, -(-left // each))
                if used < many:
                    runs.append((first + used, many - used))
                taken = min(left, used * each)
                moves.append((length, rank, rank + taken, first, capacity - gap, each))
                full, rest = divmod(taken, each)
                if full:
                    updated.append((gap - each * length, first, full))
                if rest:
                    updated.append((gap - rest * length, first + full, 1))
                rank, left = rank + taken, left - taken
            if runs:
                gaps[gap] = runs
            if not left:
                break
        if left:
            each = capacity // length
            used = -(-left // each)
            moves.append((length, rank, rank + left, fresh, 0, each))
            full, rest = divmod(left, each)
            if full:
                updated.append((capacity - each * length, fresh, full))
            if rest:
                updated.append((capacity - rest * length, fresh + full, 1))
            fresh += used
        for gap, first, many in updated:
            if gap:
                gaps.setdefault(gap, []).append((first, many))
    return moves


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """items plus sequence_id and offset (long); items has `length` and is told apart by `order`.

    items is read several times: hand in a staged or cheap table.
    """
    spark = items.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = staged(parts.withColumn("_before", F.coalesce(before, F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    found = sweeps(counts, capacity)
    moves = spark.createDataFrame(found, "length long, _from long, _to long, _first long, _at long, _each long")
    moves = F.broadcast(moves) if len(found) <= MOVES_MOST else moves
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_r", within).join(parts.drop("_n"), ["length", "_salt"]).withColumn("_rank", F.col("_r") - 1 + F.col("_before"))
    placed = ranked.alias("i").join(moves.alias("m"), (F.col("i.length") == F.col("m.length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *(F.col(f"i.{c}") for c in items.columns),
        (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_each")) * F.col("i.length")).cast("long").alias("offset"),
    )


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text), longer documents cut at the capacity."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunkweave.llm.tokens import words_of

        words = words_of(tokenizer, byte_level=False)
        for b in batches:
            rows: list[tuple] = []
            ids, ends = words.encode(b.column(1), end_id)
            data, ends = memoryview(ids.astype("<u4").tobytes()), ends.tolist()
            for doc, first, last in zip(b.column(0).to_pylist(), ends, ends[1:], strict=False):
                for k, at in enumerate(range(first, last, capacity)):
                    part = data[4 * at : 4 * min(at + capacity, last)]
                    rows.append((doc, k, at - first, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
