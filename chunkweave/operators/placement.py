"""Placement methods by name, run as independent cells.

A cell is (method, capacity ratio, nodes, protected share). All cells of an experiment are rows, and
each is one group of one grouped function, so a matrix runs as wide as it has cells. A cell reads the
whole catalog, which is what a sequential selection needs.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.operators import select as S
from chunkweave.operators.graph import Closest, merged_groups
from chunkweave.staging import staged

#: name -> (value of a file, clusters, selection, placement, protected share)
METHODS = {
    "cloud_only": (None, False, None, None, 0.0),
    "edge_only": (None, False, "all", "modulo", 0.0),
    "popularity_only": ("heat", False, "popularity", "balanced", 0.0),
    "dedup_only": ("raw_size", False, "completion", "balanced", 0.0),
    "greedy_benefit_size": ("gain", False, "completion", "balanced", 0.0),
    "graph_community": ("boosted", False, "completion", "balanced", 0.0),
    "mean": ("heat", True, "density", "fill", 0.0),
    "theoretical_weighted": ("gain", True, "density", "spread", 0.0),
    "ladedup_only": ("gain_parallel", True, "density", "spread", 0.0),
    "theoretical_v4": ("gain_filled", True, "density", "fill", 0.0),
    "topfirst_v1": ("gain", True, "hot_first", "best_effort", 0.05),
    "topfirst_v2": ("gain_parallel", True, "hot_first", "best_effort", 0.25),
    "directprotect_v1": ("gain", True, "direct", "spread", 0.05),
    "ladedup_two": ("gain_parallel", True, "direct", "spread", 0.15),
}
ALIASES = {"MEAN": "mean", "LADedup-only": "ladedup_only", "LADedup-two": "ladedup_two", "directprotect_v2": "ladedup_two", "version3": "ladedup_only", "version4": "theoretical_v4", "heat_only_spread": "popularity_only", "Edge_only": "edge_only", "Cloud_only": "cloud_only", "Dedup_only": "dedup_only"}


def method(name: str) -> str:
    """A method's own name, from itself or an alias."""
    found = ALIASES.get(name, name.lower().replace("-", "_"))
    if found not in METHODS:
        raise ValueError(f"no placement method {name!r}")
    return found


def closest(files: S.Chunks, value: dict[int, float], k: int) -> list[tuple[int, int, float]]:
    """The k pairs of least distance under 1, as smallest_pairs keeps them; one file's pairs are in memory at a time."""
    ids = sorted(files)
    total = np.array([sum(s for _, s in files[f]) for f in ids], np.int64)
    worth = np.array([value[f] for f in ids], np.float64)
    own = np.divide(worth, total, out=np.zeros(len(ids)), where=total != 0)
    users: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    for i, f in enumerate(ids):
        for c, s in dict(files[f]).items():
            users.setdefault(c, []).append(i)
            size[c] = s
    shared = {c: np.array(u) for c, u in users.items() if len(u) > 1}
    kept = Closest(k)
    for i, f in enumerate(ids):
        mine = [c for c in dict(files[f]) if c in shared]
        if not mine:
            continue
        later = [(x := shared[c])[np.searchsorted(x, i, "right") :] for c in mine]
        v, at = np.unique(np.concatenate(later), return_inverse=True)
        if not len(v):
            continue
        n = np.bincount(at, np.repeat([size[c] for c in mine], [len(x) for x in later])).astype(np.int64)
        union = total[i] + total[v] - n
        good = (union > 0) & (n > 0)
        v, n, union = v[good], n[good], union[good]
        distance = 1 - n / union
        good = ((worth[i] + worth[v]) / union >= np.maximum(own[i], own[v])) & (distance < 1.0) & (distance < kept.worst)
        for j, d in zip(v[good].tolist(), distance[good].tolist(), strict=True):
            kept.add((f, ids[j], d))
    return kept.pairs()


def clustered(files: S.Chunks, score: dict[int, float], raw: dict[int, int], k: int, rounds: int) -> tuple[S.Chunks, dict[int, set[int]]]:
    """Files merged by pair distance: in a round the k closest pairs, if there are so many under 1."""
    groups, now = {f: {f} for f in files}, dict(files)
    value = dict(score)
    fresh = max(files, default=0)
    for _ in range(rounds):
        close = closest(now, value, k)
        if len(close) < k:
            break
        gone: set[int] = set()
        for group in merged_groups([(u, v) for u, v, _ in close]):
            fresh += 1
            chunks: dict[int, int] = {}
            for f in group:
                chunks |= {c: s for c, s in now[f] if c not in chunks}
            now[fresh] = list(chunks.items())
            groups[fresh] = set().union(*(groups[f] for f in group))
            value[fresh] = sum(value[f] for f in group)
            gone |= set(group)
        for f in gone:
            now.pop(f)
    return now, {f: groups[f] for f in now}


def run_cell(files: S.Chunks, info: pd.DataFrame, name: str, ratio: float, nodes: int, protect: float | None = None, k: int = 1000, rounds: int = 5) -> tuple[list[int], dict[int, int]]:
    """(selected files, node of each placed chunk) of one method; info has file_id, heat, raw_size and the method's value column."""
    value_of, cluster, selection, placing, share = METHODS[method(name)]
    sizes = {c: s for cs in files.values() for c, s in cs}
    capacity = sum(sizes.values()) * ratio
    if selection is None:
        return [], {}
    if selection == "all":
        return sorted(files), {c: (c - 1) % nodes + 1 for c in sizes}
    heat = dict(zip(info["file_id"], info["heat"], strict=True))
    value = dict(zip(info["file_id"], info[value_of], strict=True))
    servers = S.Servers(nodes, capacity / nodes)
    if selection == "popularity":
        return S.popularity(files, heat, capacity, servers), servers.of
    if selection == "completion":
        return S.completion_greedy(files, value, capacity, servers), servers.of
    share = share if protect is None else protect
    hot = sorted(files, key=lambda f: (-heat[f], f))
    protected = set(hot[: max(1, -int(-(len(hot) * share) // 1))]) if hot else set()
    kept: list[int] = []
    stored: set[int] = set()
    if selection == "direct":
        kept, stored, used = S.direct_protect(files, heat, protected, capacity, servers)
        admitted = set(kept)
        files, capacity = {f: c for f, c in files.items() if f not in admitted}, capacity - used
    raw = dict(zip(info["file_id"], info["raw_size"], strict=True))
    groups, of = clustered(files, value, raw, k, rounds) if cluster else (files, {f: {f} for f in files})
    order = {i + 1: g for i, g in enumerate(groups)}
    chunks = {i: groups[g] for i, g in order.items()}
    total = lambda table, i: sum(table[f] for f in of[order[i]])
    if selection == "hot_first":
        cluster_heat = {i: total(heat, i) for i in order}
        hot_groups = {i for i in order if of[order[i]] & protected}
        picked, _ = S.hot_first(chunks, cluster_heat, {i: total(value, i) for i in order}, hot_groups, capacity)
    else:
        picked, _ = S.density_select(chunks, {i: total(value, i) for i in order}, capacity, stored, selection == "density")
    for i in sorted(picked):
        new = S.new_chunks(chunks[i], stored)
        if placing == "fill":
            servers.fill(new)
        else:
            plan = servers.spread(new, placing == "spread")
            servers.commit(plan or [])
        stored |= {c for c, _ in new}
    return sorted(set(kept).union(*(of[order[i]] for i in picked))), servers.of


def run_cells(cells: DataFrame, edges: DataFrame, info: DataFrame) -> DataFrame:
    """(cell, kind, id, node): kind `file` for selected files and `chunk` for placed chunks.

    cells(cell, method, ratio, nodes, protect); edges(file_id, seq, chunk_id, size); info(file_id,
    heat, raw_size, gain, gain_parallel, gain_filled, boosted).
    """
    each = F.broadcast(cells)  # cells are a few settings, and each reads the catalog
    chunks = each.select(F.col("cell").alias("of")).join(edges.select("file_id", "seq", "chunk_id", "size"), F.lit(True))
    rows = each.join(info, F.lit(True))

    def fold(c: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, int, int]] = []
        if len(c):
            x = x.sort_values("file_id")
            files = by_file(c, "size")
            r = x.iloc[0]
            picked, placed = run_cell(files, x, r["method"], float(r["ratio"]), int(r["nodes"]), None if pd.isna(r["protect"]) else float(r["protect"]))
            out = [(r["cell"], "file", f, 0) for f in picked] + [(r["cell"], "chunk", k, n) for k, n in sorted(placed.items())]
        return pd.DataFrame(out, columns=["cell", "kind", "id", "node"])

    return chunks.groupBy("of").cogroup(rows.groupBy("cell")).applyInPandas(fold, "cell string, kind string, id long, node int")


def cell_key(settings: dict, inputs: dict[str, str]) -> str:
    """Address of a cell's result: the digest of its settings and of the digests of what it reads."""
    return hashlib.sha256(json.dumps({"settings": settings, "inputs": inputs}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def table_digest(rows: DataFrame) -> str:
    """Digest of a table's rows in any order: their count and the sums of two hashes."""
    h = F.xxhash64(*rows.columns)
    r = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(F.hash(*rows.columns).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{rows.dtypes}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def cached_cells(cells: DataFrame, edges: DataFrame, info: DataFrame, path: str) -> tuple[DataFrame, int]:
    """run_cells(), each cell's rows kept under its key in `path`; and how many cells were run now.

    Cells are a few settings and come to the driver. A cell whose key is there already isn't run again;
    a key changes with any setting and any row of the catalog.
    """
    spark = cells.sparkSession
    inputs = {"edges": table_digest(edges), "info": table_digest(info)}
    of = {r["cell"]: cell_key({**r.asDict(), "cell": None}, inputs) for r in cells.collect()}
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda key: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_SUCCESS"))
    todo = {cell: key for cell, key in of.items() if not there(key)}
    if todo:
        new = staged(run_cells(cells.where(F.col("cell").isin(*todo)), edges, info), "cells")
        for cell, key in todo.items():
            new.where(F.col("cell") == cell).drop("cell").write.mode("overwrite").parquet(f"{path}/{key}")
    out = [spark.read.schema("kind string, id long, node int").parquet(f"{path}/{key}").withColumn("cell", F.lit(cell)) for cell, key in of.items()]
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.select("cell", "kind", "id", "node"), len(todo)


def by_file(rows: pd.DataFrame, size: str) -> S.Chunks:
    """Each file's chunks in order, from rows with file_id, seq, chunk_id and a column of sizes."""
    rows = rows.sort_values(["file_id", "seq"])
    out: S.Chunks = {}
    for f, c, s in zip(rows["file_id"].tolist(), rows["chunk_id"].tolist(), rows[size].tolist(), strict=True):
        out.setdefault(f, []).append((c, s))
    return out


def edge_only(cell: str, edges: DataFrame, nodes: int) -> DataFrame:
    """run_cells() of the method `edge_only`, which needs no fold: every file, and chunk after chunk to the next node."""
    files = edges.select(F.col("file_id").alias("id")).distinct().select(F.lit(cell).alias("cell"), F.lit("file").alias("kind"), F.col("id").cast("long"), F.lit(0).alias("node"))
    place = ((F.col("id") - 1) % nodes + 1).cast("int")
    chunks = edges.select(F.col("chunk_id").alias("id")).distinct().select(F.lit(cell).alias("cell"), F.lit("chunk").alias("kind"), F.col("id").cast("long"), place.alias("node"))
    return files.union(chunks)


def hot_input(chunks: DataFrame, requests: DataFrame, ratio: float, only_requested: bool = True) -> tuple[DataFrame, int]:
    """hot files (path, lambda, chunks): share of requests and recipe of each; and the capacity in unique chunks."""
    n = requests.count()
    counts = requests.groupBy("path").agg((F.count("*") / F.lit(float(max(n, 1)))).alias("lambda"))
    recipe = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fp"))), lambda x: x["fp"]).alias("chunks"))
    files = recipe.join(counts, "path", "inner" if only_requested else "left").select("path", F.coalesce("lambda", F.lit(0.0)).alias("lambda"), "chunks")
    return files, int(chunks.select("fp").distinct().count() * ratio)


def hot_output(chunks: DataFrame, selected: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, seq, fp, node) of selected(path) files' places, and (node, fps) of what each node holds; nodes(fp, node)."""
    recipe = chunks.join(selected.select("path"), "path", "left_semi").select("path", "seq", "fp").join(nodes, "fp")
    held = recipe.select("node", "fp").distinct().groupBy("node").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    return recipe.select("path", "seq", "fp", "node"), held
