"""Placement queries take all files of a table, also of one with more than 200."""

import math

import pandas as pd
import pytest

from chunkweave.operators import placement
from chunkweave.operators import select as S
from chunkweave.plans import placement_queries as Q
from chunkweave.plans.corpus import Corpus

N = 230


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    # Files come in threes with a first chunk in common; the last ones are the smallest.
    text = lambda i: f"{i // 3:0512d}" + f"{i:0{2 * (N - i) + 9}d}"
    rows = [(i, text(i), "en", "s", len(text(i))) for i in range(N)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def run(spark, corpus, name):
    return Q.QUERIES[name](spark, corpus)


@pytest.fixture(scope="module")
def tables(spark, corpus):
    c = Corpus(spark, corpus)
    files = placement.by_file(Q.chunk_edges(c).toPandas(), "size")
    return files, Q.info(c).toPandas().sort_values("file_id")


@pytest.mark.parametrize("name", ["s143_density_methods", "s145_protecting_methods", "s148_completion_methods", "s152_trivial_methods"])
def test_cells_read_all_files(spark, corpus, tables, name):
    files, info = tables
    assert len(files) == N
    got = run(spark, corpus, name).toPandas()
    cells = {"s152_trivial_methods": {"edge_only@0.2"}}.get(name, set(got["cell"]))
    assert set(got["cell"]) == cells and len(cells) in (1, 4)
    for cell in cells:
        picked, placed = placement.run_cell(files, info, cell.split("@")[0], 0.2, 10)
        mine = got[got["cell"] == cell]
        assert sorted(mine[mine["kind"] == "file"]["id"]) == sorted(picked), cell
        chunks = mine[mine["kind"] == "chunk"]
        assert dict(zip(chunks["id"], chunks["node"], strict=True)) == placed
    if name != "s148_completion_methods":  # whose selections here are of the hottest files, within the capacity of all
        assert got[got["kind"] == "file"]["id"].max() > 200


def test_budget_of_all_files(spark, corpus, tables):
    files, info = tables
    got = run(spark, corpus, "s169_budget_fill").toPandas().sort_values("rank")
    total = sum({c: s for cs in files.values() for c, s in cs}.values())
    prize = {f: math.ceil(h * 1000) for f, h in zip(info["file_id"].tolist(), info["heat"].tolist(), strict=True)}
    assert got["file_id"].tolist() == S.budget_fill(files, prize, total // 5)
    assert got["file_id"].max() > 200


def test_quota_grows_over_all_files(spark, corpus):
    got = run(spark, corpus, "s166_quota_selection").toPandas()
    vertices, _ = Q.delta(Corpus(spark, corpus))
    table = {r["id"]: r for r in vertices.collect()}
    assert sorted(got["budget"]) == [sum(r["mu"] for r in table.values()) // 4 * i for i in range(1, 5)]
    for r in got.itertuples():
        picked = [int(x) for x in r.picked.split(",")]
        assert r.prize == sum(table[f]["prize"] for f in picked) and r.cost <= r.budget


def test_many_files_are_selected_in_little_time():
    files = {f: [(2 * f, 512), (2 * f + 1, f % 500 + 1), (1, 512)] for f in range(1, 5001)}
    info = pd.DataFrame({"file_id": list(files), "heat": [1.0 / f**0.7 for f in files], "raw_size": 1024})
    for column in ("gain", "gain_parallel", "gain_filled", "boosted"):
        info[column] = info["heat"]
    for name in ("mean", "topfirst_v2", "ladedup_two", "dedup_only", "popularity_only"):
        picked, _ = placement.run_cell(files, info, name, 0.2, 10, k=50)
        assert len(picked) > 500
