"""Chunkers: fixed sizes in SQL functions, content-defined ones in vectorised batches.

Every chunker takes files(<keys>, content binary) and returns one row per chunk with the file's
keys, seq, offset, length and fp (SHA-1, lower-case hex). Empty and null contents have no chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gear words of the content-defined chunker, used for byte value modulo 16.
GEAR = np.array(
    [
        0x75A3B6C1D2E4F809, 0x1F2E3D4C5B6A7988, 0x9A7B6C5D4E3F2011, 0xC3D2E1F0A9B8C7D6,
        0x13579BDF2468ACE0, 0xFEDCBA9876543210, 0x0F1E2D3C4B5A6978, 0x89ABCDEF01234567,
        0x1122334455667788, 0x8877665544332211, 0xCAFEBABEDEADBEEF, 0x1020304050607080,
        0x55AA55AA55AA55AA, 0xAA55AA55AA55AA55, 0x3141592653589793, 0x2718281828459045,
    ],
    np.uint64,
)


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """Chunks of `size` bytes, the last one shorter; stays in generated code."""
    keys = [c for c in files.columns if c != "content"]
    n = F.octet_length("content")
    seqs = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    rows = files.select(*keys, "content", F.explode(seqs).alias("seq"))
    chunk = F.substring("content", F.col("seq") * size + 1, F.lit(size))
    rows = rows.select(*keys, F.col("seq").cast("long").alias("seq"), (F.col("seq").cast("long") * size).alias("offset"), chunk.alias("chunk"))
    return rows.select(*keys, "seq", "offset", F.octet_length("chunk").cast("long").alias("length"), F.sha1("chunk").alias("fp"))


def _hits(data: np.ndarray, bits: int) -> np.ndarray:
    """Low `bits` of the gear sum at each byte, from as many bytes back as matter."""
    h = np.zeros(len(data), np.uint64)
    g = GEAR[data & 15]
    for k in range(min(bits, len(data))):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    return h & np.uint64((1 << bits) - 1)


def cut_points(data: bytes, smallest: int, average: int, largest: int, normalised: bool) -> list[int]:
    """Ends of the content-defined chunks of data.

    The hash restarts behind the smallest size of each chunk, so a place's hash only counts the
    bytes from there; places with fewer bytes than mask bits behind them are looked at one by one.
    """
    if not 0 < smallest <= average <= largest:
        raise ValueError("0 < smallest <= average <= largest is asked for")
    base = round(math.log2(average))
    bits = {k: max(1, base + k) for k in ((1, -1) if normalised else (0,))}
    raw = np.frombuffer(data, np.uint8)
    places = {k: np.flatnonzero(_hits(raw, b) == 0) for k, b in bits.items()}
    words, out, at, n = [int(x) for x in GEAR], [], 0, len(data)

    def early(k: int, start: int, lo: int, hi: int) -> int | None:
        """First boundary before the hash has a full window."""
        h, mask = 0, (1 << bits[k]) - 1
        for i in range(start, min(hi, start + bits[k])):
            h = (h << 1) + words[data[i] & 15]
            if i >= lo and h & mask == 0:
                return i
        return None

    def first(k: int, start: int, lo: int, hi: int) -> int | None:
        found = early(k, start, lo, hi)
        if found is None:
            lo = max(lo, start + bits[k])
            i = int(np.searchsorted(places[k], lo))
            if i < len(places[k]) and places[k][i] < hi:
                found = int(places[k][i])
        return found

    while at < n:
        if n - at <= smallest:
            end = n
        else:
            start, limit = at + smallest, min(n, at + largest)
            if normalised:
                turn = min(limit, at + average - 1)
                hit = first(1, start, start, turn)
                hit = first(-1, start, max(start, turn), limit) if hit is None else hit
            else:
                hit = first(0, start, start, limit)
            end = limit if hit is None else hit + 1
        out.append(end)
        at = end
    return out


def defined_chunks(files: DataFrame, smallest: int = 2048, average: int = 8192, largest: int = 16384, normalised: bool = False) -> DataFrame:
    """Content-defined chunks; `normalised` is the variant with a stricter mask up to the average size."""
    keys = [c for c in files.columns if c != "content"]
    fields = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keys)
    names = [*keys, "seq", "offset", "length", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, content in enumerate(b.column(len(keys)).to_pylist()):
                at = 0
                for k, end in enumerate(cut_points(content, smallest, average, largest, normalised) if content else []):
                    rows.append(i)
                    out.append((k, at, end - at, hashlib.sha1(content[at:end]).hexdigest()))
                    at = end
            cols = list(zip(*out, strict=True)) or [()] * 4
            own = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names)

    return files.select(*keys, "content").mapInArrow(run, f"{fields}seq long, offset long, length long, fp string")


def chunks(files: DataFrame, method: str, size: int) -> DataFrame:
    """By method: fixed, cdc or fastcdc; content-defined ones take a quarter and four times the size as limits."""
    if method == "fixed":
        return fixed_chunks(files, size)
    if method in ("cdc", "fastcdc"):
        return defined_chunks(files, max(1, size // 4), size, size * 4, method == "fastcdc")
    raise ValueError(f"no chunking method {method!r}")


def filler(fp: Column, size: Column) -> Column:
    """The bytes of a synthetic chunk: its fingerprint's bytes over and over, `size` long."""
    raw = F.unhex(fp)
    return F.substring(F.unhex(F.repeat(F.hex(raw), F.ceil(size / 20).cast("int"))), F.lit(1), size.cast("int"))
