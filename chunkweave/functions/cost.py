"""The analytic restore-time model and ratio helpers, all as column expressions.

Times are in seconds, bandwidths in bits a second. Empty files take no time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.config import LinkModel


def _c(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rate_bps(text: Column) -> Column:
    """`100mbit`, `1.5gbit`, `9600bps`, `8kbit` in bits a second; null for other texts."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9.]+)\s*(?:gbit|mbit|kbit|bit|bps)$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^[0-9.]+\s*(gbit|mbit|kbit|bit|bps)$", 1)
    return number.try_cast("double") * F.when(unit == "gbit", 1e9).when(unit == "mbit", 1e6).when(unit == "kbit", 1e3).when(unit.isin("bit", "bps"), 1.0)


def duration_s(text: Column) -> Column:
    """`25ms`, `5us`, `1s` in seconds; null for other texts."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9.]+)\s*(?:ms|us|s)$", 1)
    unit = F.regexp_extract(t, r"^[0-9.]+\s*(ms|us|s)$", 1)
    return number.try_cast("double") * F.when(unit == "ms", 1e-3).when(unit == "us", 1e-6).when(unit == "s", 1.0)


def link_bps(a: Column, b: Column) -> Column:
    return F.least(a, b)


def link_rtt(a: Column, b: Column) -> Column:
    return a + b


def full_time(n_bytes: Column, n_chunks: Column, bps: float, rtt: float, batch: int) -> Column:
    t = F.ceil(n_chunks / F.lit(float(batch))) * rtt + n_bytes.cast("double") * 8.0 / bps
    return F.when((n_bytes <= 0) | (n_chunks <= 0), F.lit(0.0)).otherwise(t)


def parallel_time(n_bytes: Column, n_chunks: Column, m: LinkModel) -> Column:
    """From several edge nodes at once."""
    nodes = F.greatest(F.lit(1), F.least(F.lit(m.nodes), n_chunks))
    t = F.ceil(n_chunks / (F.lit(float(m.batch)) * nodes)) * m.edge_rtt + n_bytes.cast("double") / nodes * 8.0 / m.edge_bps
    return F.when((n_bytes <= 0) | (n_chunks <= 0), F.lit(0.0)).otherwise(t)


def hybrid_time(n_bytes: Column, n_chunks: Column, ratio: Column | float, m: LinkModel, parallel: bool = False) -> Column:
    """A share from the edge and the rest from the cloud at the same time."""
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(ratio)))
    edge_chunks = F.ceil(n_chunks * r)
    edge_bytes = n_bytes.cast("double") * r
    cloud_bytes = F.greatest(F.lit(0.0), n_bytes.cast("double") - edge_bytes)
    whole = lambda x: F.floor(x).cast("long")
    edge = parallel_time(whole(edge_bytes), edge_chunks, m) if parallel else full_time(whole(edge_bytes), edge_chunks, m.edge_bps, m.edge_rtt, m.batch)
    cloud = full_time(whole(cloud_bytes), F.greatest(F.lit(0), n_chunks - edge_chunks), m.cloud_bps, m.cloud_rtt, m.batch)
    return F.when((n_bytes <= 0) | (n_chunks <= 0), F.lit(0.0)).otherwise(F.greatest(edge, cloud))


def baseline_time(n_bytes: Column, n_chunks: Column, ratio: float, m: LinkModel, parallel: bool = False, parallel_hybrid: bool | None = None) -> Column:
    """What a restore takes without placement: from the cloud, the edge or both, by the edge's share."""
    if ratio <= 0:
        return full_time(n_bytes, n_chunks, m.cloud_bps, m.cloud_rtt, m.batch)
    if ratio >= 1:
        return parallel_time(n_bytes, n_chunks, m) if parallel else full_time(n_bytes, n_chunks, m.edge_bps, m.edge_rtt, m.batch)
    return hybrid_time(n_bytes, n_chunks, ratio, m, parallel if parallel_hybrid is None else parallel_hybrid)


def gain(n_bytes: Column, n_chunks: Column, m: LinkModel, baseline_ratio: float = 0.0, parallel: bool = False, parallel_hybrid: bool | None = None) -> Column:
    edge = parallel_time(n_bytes, n_chunks, m) if parallel else full_time(n_bytes, n_chunks, m.edge_bps, m.edge_rtt, m.batch)
    return F.greatest(F.lit(0.0), baseline_time(n_bytes, n_chunks, baseline_ratio, m, parallel, parallel_hybrid) - edge)


def filled_time(n_bytes: Column, n_chunks: Column, m: LinkModel, capacity: float) -> Column:
    """From nodes filled one after the other up to `capacity` bytes each: the segments' times add up.

    A segment's chunks are its share of the bytes, rounded half to even, at least one, and the last
    segment has what is left; infinite if the nodes can't hold the file.
    """
    if capacity <= 0:
        return F.when((n_bytes <= 0) | (n_chunks <= 0), F.lit(0.0)).otherwise(F.lit(float("inf")))
    total = n_bytes.cast("double")
    used = F.ceil(total / capacity).cast("int")

    def step(acc: Column, i: Column) -> Column:
        part = F.least(F.lit(float(capacity)), total - i * F.lit(float(capacity)))
        share = F.bround(n_chunks * part / total).cast("long")
        mine = F.when(i == used - 1, n_chunks - acc["chunks"]).otherwise(F.least(F.greatest(share, F.lit(1)), n_chunks - acc["chunks"]))
        t = F.ceil(mine / F.lit(float(m.batch))) * m.edge_rtt + part * 8.0 / m.edge_bps
        return F.struct((acc["chunks"] + mine).cast("long").alias("chunks"), (acc["t"] + t).alias("t"))

    start = F.struct(F.lit(0).cast("long").alias("chunks"), F.lit(0.0).alias("t"))
    t = F.aggregate(F.sequence(F.lit(0), used - 1), start, step, lambda a: a["t"])
    return F.when((n_bytes <= 0) | (n_chunks <= 0), F.lit(0.0)).when(used > m.nodes, F.lit(float("inf"))).otherwise(t)


def dedup_ratio(original: Column, unique: Column) -> Column:
    """original / unique; 1 for nothing at all, 9999 if nothing is unique."""
    return F.when((original == 0) & (unique == 0), F.lit(1.0)).when(unique == 0, F.lit(9999.0)).otherwise(original / unique)


def mib_per_s(n_bytes: Column, seconds: Column, floor: float | None = 0.001) -> Column:
    """MiB a second; no time counts as `floor` seconds, or as no throughput if that is None."""
    if floor is None:
        return F.when(seconds <= 0, F.lit(0.0)).otherwise(n_bytes / 1048576.0 / seconds)
    return n_bytes / 1048576.0 / F.when(seconds <= 0, F.lit(floor)).otherwise(seconds)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prize(rate_path: Column, rate_base: Column, own: Column, heat: Column, scale: float) -> Column:
    """First known of four: a rate by path or base name (an integer), the file's prize or heat times scale, rounded up; else 1."""
    scaled = lambda x: F.ceil(x * scale).cast("long")
    return F.greatest(F.lit(0), F.coalesce(rate_path.cast("long"), rate_base.cast("long"), scaled(own), scaled(heat), F.lit(1).cast("long")))
