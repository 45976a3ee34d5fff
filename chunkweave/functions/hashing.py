"""Hashes that the formats fix: SHA-1 and SHA-256 in SQL, 64-bit FNV-1a and jump hash as vectorised functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the hash definitions.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
JUMP_FACTOR = 2862933555777941757
_MASK = (1 << 64) - 1


def fnv1a(data: bytes, basis: int = FNV_BASIS) -> int:
    h = basis
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def fnv1a_all(strings: pd.Series) -> np.ndarray:
    """FNV-1a of each string: one vector step for each byte place."""
    data = [s.encode() if isinstance(s, str) else b"" for s in strings]
    h = np.full(len(data), FNV_BASIS, np.uint64)
    sizes = np.array([len(d) for d in data], np.int64)
    joined = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        for k in range(int(sizes.max(initial=0))):
            on = sizes > k
            h[on] = (h[on] ^ joined[starts[on] + k]) * np.uint64(FNV_PRIME)
    return h


def jump(key: int, buckets: int) -> int:
    """Jump consistent hash (Lamping and Veach) of a key: a bucket from 0."""
    at, nxt = -1, 0
    while nxt < buckets:
        at = nxt
        key = (key * JUMP_FACTOR + 1) & _MASK
        nxt = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@F.pandas_udf(DecimalType(20, 0))
def fnv1a_64(s: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(int(x)) for x in fnv1a_all(s)])


def jump_node(fp: Column, nodes: int) -> Column:
    """Node number from 1 by jump hash over the FNV-1a of the fingerprint."""

    @F.pandas_udf("int")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([jump(int(h), nodes) + 1 for h in fnv1a_all(s)], dtype="int32")

    return of(fp)


def edge_by_ratio(fp: Column, ratio: float) -> Column:
    """Whether a chunk is read from the edge: a share `ratio` of all fingerprints by hash."""
    if ratio <= 0:
        return F.lit(False)
    if ratio >= 1:
        return F.lit(True)
    limit = int(ratio * float(_MASK))

    @F.pandas_udf("boolean")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_all(s) <= np.uint64(min(limit, _MASK)))

    return of(fp)


def seeded_rank_key(seed: int, key: Column) -> Column:
    """A reproducible shuffle key: SHA-1 of seed and key, the same in any SQL engine."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key))


def content_digest(col: Column) -> Column:
    return F.sha2(col, 256)


def project_name(prefix: str, path: Column) -> Column:
    """prefix-<first ten digits of the path's SHA-1>."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(path), 1, 10))
