import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from chunkweave.config import EngineConfig, LinkModel, key_values, simple_yaml
from chunkweave.functions import chunking, cost, hashing, naming
from chunkweave.sources import readers


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row.asDict()


def test_hash_vectors():
    keys = [hashing.fnv1a(x) for x in (b"", b"a", b"abc")] + [hashing.fnv1a(hashlib.sha1(b"abc").hexdigest().encode())]
    assert keys == [14695981039346656037, 12638187200555641996, 16654208175385433931, 6771386652313915932]
    assert [[hashing.jump(k, n) for n in (2, 3, 10)] for k in keys] == [[1, 1, 1], [1, 2, 2], [0, 2, 5], [1, 2, 7]]


def plain_cuts(data, low, average, high, normalised):
    bits = lambda k: (1 << max(1, round(math.log2(average)) + k)) - 1
    out, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= low else at + low
        h, limit = 0, min(len(data), at + high)
        while len(data) - at > low and end < limit:
            h = ((h << 1) + int(chunking.GEAR[data[end] & 15])) % (1 << 64)
            size = end - at + 1
            end += 1
            if h & bits((1 if size < average else -1) if normalised else 0) == 0:
                break
        out.append(end)
        at = end
    return out


@pytest.mark.parametrize("normalised", [False, True])
def test_cut_points_are_those_of_the_byte_loop(normalised):
    rng = random.Random(1)
    for n in (0, 1, 5, 100, 1000, 5000):
        data = bytes(rng.choice(b"abcdefgh ijklmn\x00\xff") for _ in range(n))
        for limits in ((4, 16, 64), (16, 64, 256), (1, 1, 1), (50, 51, 52), (2048, 8192, 16384)):
            assert chunking.cut_points(data, *limits, normalised) == plain_cuts(data, *limits, normalised)


def test_chunkers_cover_the_content(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 1300)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    for method in ("fixed", "cdc", "fastcdc"):
        rows = chunking.chunks(files, method, 512).orderBy("path", "seq").collect()
        assert {r["path"] for r in rows} == {"a"}
        assert sum(r["length"] for r in rows) == 1300 and [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
    with pytest.raises(ValueError):
        chunking.chunks(files, "none", 512)


def test_restore_times(spark):
    m, b, n = LinkModel(), F.lit(1 << 20), F.lit(128)
    got = one(spark, cloud=cost.full_time(b, n, m.cloud_bps, m.cloud_rtt, 128), edge=cost.full_time(b, n, m.edge_bps, m.edge_rtt, 128), none=cost.full_time(F.lit(0), n, 1.0, 1.0, 1), lost=cost.filled_time(b, n, m, 1000.0), fits=cost.filled_time(b, n, m, float(1 << 20)))
    assert got["cloud"] == pytest.approx(0.13388608) and got["edge"] == pytest.approx(0.007592405333) and got["none"] == 0
    assert math.isinf(got["lost"]) and got["fits"] == pytest.approx(got["edge"])
    ratios = one(spark, a=cost.dedup_ratio(F.lit(0), F.lit(0)), b=cost.dedup_ratio(F.lit(5), F.lit(0)), c=cost.dedup_ratio(F.lit(6), F.lit(3)), d=cost.mib_per_s(F.lit(1048576), F.lit(0.0), None), e=cost.mib_per_s(F.lit(1048576), F.lit(0.0)))
    assert ratios == {"a": 1.0, "b": 9999.0, "c": 2.0, "d": 0.0, "e": pytest.approx(1000.0)}


def test_names(spark):
    long = "/data/" + "x y" * 180 + ".txt"
    rows = spark.createDataFrame([("/input/github_repo/org/repo/v1/source_code.zip",), (long,), ("/a/???",)], "path string")
    names = {r["path"]: r for r in rows.select("path", naming.recipe_name(F.col("path")).alias("n")).collect()}
    assert all(len(r["n"].encode()) <= 255 and r["n"].endswith(".recipe") for r in names.values())
    assert names["/a/???"]["n"].startswith("file-")
    got = rows.limit(1).select(naming.object_candidates(F.col("path"), F.lit("/data/recipe/source_code.zip-0123456789abcdef.recipe")).alias("c")).first()["c"]
    assert got == ["-input-github_repo-org-repo-v1-source_code.zip", "source_code.zip-f108cc0ee6434668496027646580b66cc3923b86", "source_code.zip-0123456789abcdef"]
    path = one(spark, a=naming.normalised(F.lit("\\a\\.\\b\\..\\c//d")), b=naming.top_folder(F.lit("x.txt")), c=naming.top_folder(F.lit("a/x.txt")), d=naming.top_folder(F.lit(None).cast("string")))
    assert path == {"a": "a/c/d", "b": "(root)", "c": "a", "d": "(unknown)"}


def test_request_lines(spark):
    cases = {"/input/a.txt": (None, "/input/a.txt", ""), "/input/a.txt\t/output/a.txt": (None, "/input/a.txt", "/output/a.txt"), "0.125\t/input/a.txt": (0.125, "/input/a.txt", ""), "0.125\t/input/a.txt\t/output/a.txt": (0.125, "/input/a.txt", "/output/a.txt"), "3 in  out": (3.0, "in", "out")}
    t, i, o = readers.request_fields(F.col("line"))
    for r in spark.createDataFrame([(c,) for c in cases], "line string").select("line", t.alias("t"), i.alias("i"), o.alias("o")).collect():
        assert (r["t"], r["i"], r["o"]) == cases[r["line"]]


def test_config():
    assert key_values("# x\na = 1\nb='q'\na=2\n") == {"a": "2", "b": "q"}
    y = simple_yaml("put_batch: 64\nnodes:\n  - e1\n  - e2\nplacer: random # x\n")
    c = EngineConfig().overridden(y)
    assert (c.put_batch, c.nodes, c.placer, c.get_batch) == (64, ("e1", "e2"), "random", 128)
