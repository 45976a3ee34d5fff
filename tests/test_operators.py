import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkweave.functions.chunking import fixed_chunks
from chunkweave.operators import catalog, containers, dedup, restore, workload
from chunkweave.sources import readers, writers
from chunkweave.staging import numbered
from chunkweave.streaming import incremental


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", b"11112222"), ("b", b"22223333"), ("c", b""), ("d", b"1111")]
    return fixed_chunks(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), 4)


def test_numbering_is_the_whole_order(spark):
    rows = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"], "n").orderBy("k").select("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))
    assert numbered(spark.range(0), ["id"], "n").count() == 0


def test_first_seen_and_stats(spark, chunks):
    ids = catalog.chunk_ids(chunks).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in ids] == [1, 2, 3]
    placed = dedup.place_round_robin(catalog.first_seen(chunks), 2)
    stats = {r["path"]: r for r in dedup.file_stats(dedup.marked(chunks), placed, True).collect()}
    assert [stats[p]["unique_bytes"] for p in "abd"] == [8, 4, 0] and stats["d"]["dedup_ratio"] == 9999.0 and stats["a"]["network_sent_bytes"] == 16
    prior = chunks.where("path = 'a'").select("fp")
    assert catalog.first_seen(chunks, prior).count() == 1


def test_containers(spark):
    assert containers.most_entries(32 << 10) == 1169
    assert containers.next_fit([4, 4, 4, 20, 1], 10, 1000) == [(0, 0), (0, 4), (1, 0), (2, 0), (3, 0)]
    assert containers.next_fit([1, 1, 1], 100, 16 + 28 * 2) == [(0, 0), (0, 1), (1, 0)]
    got = containers.simulate_reads([(1, 5), (2, 5), (1, 5), (1, 5)], {1: 50, 2: 60}, 0, 10)
    assert got == {"cache_hits": 1, "cache_misses": 3, "useful_bytes": 20, "container_loaded_bytes": 160, "meta_read_bytes": 30}
    rows = [(1, "p", i, f"{i:040x}", 3, bytearray(bytes([i]) * 3)) for i in range(5)]
    placed = spark.createDataFrame(rows, "node int, path string, seq long, fp string, length long, data binary")
    packed = containers.pack(placed, 7, 1000)
    for single in (False, True):
        images = containers.container_images(packed, placed, 7, 1000, single)
        back = {r["fp"]: bytes(r["data"]) for r in containers.read_image(images, 1000).collect()}
        assert back == {r[3]: bytes(r[5]) for r in rows}


def test_container_bytes(spark):
    """Data, zeros up to the data size in the one file, then id, chunks, bytes, and each chunk's fingerprint, length and offset."""
    fps = ["01" * 20, "ab" * 20]
    placed = spark.createDataFrame([(3, "p", 0, fps[0], 2, bytearray(b"xy")), (3, "p", 1, fps[1], 3, bytearray(b"abc"))], "node int, path string, seq long, fp string, length long, data binary")
    packed = containers.pack(placed, 8, 100, 1000)
    meta = bytes.fromhex("00000000000003e8" + "00000002" + "00000005" + fps[0] + "00000002" + "00000000" + fps[1] + "00000003" + "00000002").ljust(100, b"\0")
    for single, data in ((False, b"xyabc"), (True, b"xyabc\0\0\0")):
        assert bytes(containers.container_images(packed, placed, 8, 100, single).first()["image"]) == data + meta
    cut = containers.container_images(packed, placed, 8, 100).withColumn("container_id", F.lit(7).cast("long"))
    with pytest.raises(PySparkException):
        containers.read_image(cut, 100).collect()


def test_restore(spark, chunks):
    index = catalog.first_seen(chunks).select("fp", F.when(F.col("path") == "b", 0).otherwise(1).alias("node"))
    p = {r["path"]: r for r in restore.policy(chunks, index, 10, 0).collect()}
    assert p["b"]["cloud_full"] and not p["a"]["cloud_full"]
    store = spark.createDataFrame([(x,) for x in ("1111", "2222", "3333")], "s string").select(F.sha1("s").alias("fp"), F.encode("s", "UTF-8").alias("data"))
    assert {r["path"]: bytes(r["content"]) for r in restore.reassembled(chunks, store).collect()} == {"a": b"11112222", "b": b"22223333", "d": b"1111"}
    with pytest.raises(PySparkException):
        restore.reassembled(chunks, store.limit(1)).collect()


def test_sampling(spark):
    files = spark.createDataFrame([("a", 0.0), ("b", -1.0), ("c", 3.0), ("d", None)], "path string, heat double")
    assert {r["path"] for r in workload.sample_with_replacement(files, 50, 1).collect()} == {"c"}
    flat = files.withColumn("heat", F.lit(0.0))
    assert workload.sample_without_replacement(flat, 4, 1).count() == 4


def trace_bytes(method, params, files):
    """A hash trace as the format lays it out."""
    head = struct.pack("<IIQ", 0xDEADDEAD, 7, len(files)) + b"/root".ljust(4096, b"\0") + struct.pack("<QI", 2, method) + params.ljust(44, b"\0")
    head += struct.pack("<II", 1, 48) + b"host".ljust(4096, b"\0") + struct.pack("<QQQ", 11, 12, 30)
    for path, target, chunks in files:
        head += struct.pack("<QQII", 30, 1, 5, 6) + struct.pack("<7Q", *range(7)) + struct.pack("<QII", len(chunks), len(path), len(target)) + path + target
        for size, digest in chunks:
            head += (struct.pack("<I", size) if method == 2 else b"") + digest + b"\x09"
    return head


def test_hash_traces(spark, tmp_path):
    files = [(b"/root/x/y\0", b"", [(10, b"abcdef"), (20, b"ghijkl")]), (b"/root/z\0", b"/t", [(7, b"mnopqr")]), (b"/other", b"", [])]
    got = list(readers.trace_records(trace_bytes(2, b"", files)))
    assert got == [("x/y", [(b"abcdef".hex(), 10), (b"ghijkl".hex(), 20)]), ("z", [(b"mnopqr".hex(), 7)]), ("other", [])]
    assert [n for _, c in readers.trace_records(trace_bytes(1, struct.pack("<I", 4096), files)) for _, n in c] == [4096] * 3
    (tmp_path / "t.hash").write_bytes(trace_bytes(2, b"", files))
    assert readers.fsl(spark, str(tmp_path / "t.hash")).count() == 3
    at = lambda algorithm, bits, low, high: struct.pack("<I20xI8xII", algorithm, bits, low, high)
    cases = [(1, at(512, 3, 0, 0), 512), (2, at(3, 13, 1, 2), 8192), (2, at(2, 12, 0, 0), 4096), (2, at(1, 12, 100, 300), 200), (2, at(3, 31, 100, 300), 200), (2, at(3, 0, 9, 5), 8192), (3, at(3, 13, 0, 0), 8192)]
    assert [readers.trace_chunk_bytes(m, p) for m, p, _ in cases] == [n for _, _, n in cases]
    with pytest.raises(ValueError):
        list(readers.trace_records(trace_bytes(2, b"", files)[:-3]))


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"hash2edge_node_id": {"aa": " edge3 ", "bb": 3.0, "cc": true, " ": "x"}}')
    assert {r["fp"]: r["node_ref"] for r in readers.placement_json(spark, str(tmp_path / "p.json")).collect()} == {"aa": "edge3", "bb": "3"}
    (tmp_path / "q.txt").write_text("# c\naa,edge1\nbb  2 # x\n\n")
    assert {r["fp"]: r["node_ref"] for r in readers.placement_text(spark, str(tmp_path / "q.txt")).collect()} == {"aa": "edge1", "bb": "2"}
    assert {r["fp"]: r["node_ref"] for r in readers.placement_folder(spark, str(tmp_path)).collect()} == {"aa": "edge1", "bb": "2"}
    (tmp_path / "g.idx").write_text('{"hash_to_node": {"a": 3, "b": "edge2", "c": "cloud", "d": "x", "e": 4.0}}')
    assert {r["fp"]: r["node"] for r in readers.global_index(spark, str(tmp_path / "g.idx")).collect()} == {"a": 3, "b": 2, "c": 0, "e": 4}
    assert readers.global_index(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.rates").write_text('{"a": 3, "b": 0.0015}')
    assert {r["path"]: r["rate"] for r in readers.rates(spark, str(tmp_path / "r.rates")).collect()} == {"a": 3, "b": 2}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.TXT").write_text("hello")
    (tmp_path / "in/y.log").write_text("hello")
    assert [r["path"] for r in readers.files(spark, str(tmp_path / "in"), extensions=["txt"]).collect()] == ["x.TXT"]


def test_fileinfo_checks(spark, tmp_path):
    doc = '{"format_version":"mean_go_v1","chunk_bytes":4,"total_size":4,"uni_fingerprint":["aa"],"uni_size":[4],"files":[{"path":"x","chunk_ids":[%d],"chunk_sizes":[4],"heat":1.0,"heat_dsize":0.25}]}'
    (tmp_path / "good.json").write_text(doc % 1)
    (tmp_path / "bad.json").write_text(doc % 2)
    file, chunk, edge = readers.catalog_tables(readers.fileinfo(spark, str(tmp_path / "good.json")))
    assert (file.count(), chunk.count(), edge.count()) == (1, 1, 1)
    with pytest.raises(PySparkException):
        readers.fileinfo(spark, str(tmp_path / "bad.json")).collect()


def test_objects(spark):
    files = spark.createDataFrame([("a/x", bytearray(b"1")), ("a/y", bytearray(b"2"))], "path string, content binary")
    existing = spark.createDataFrame([("a-x",)], "object_name string")
    rows, counts = writers.objects(files, existing, False)
    assert {r["object_name"] for r in rows.collect()} == {"a-y"} and {r["action"]: r["count"] for r in counts.collect()} == {"created": 1, "skipped": 1}


def test_incremental_stream(spark, tmp_path):
    schema = "ts timestamp, path string, seq long, length long, fp string"
    for name, rows in (("1", [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")]), ("2", [("c", 0, "x"), ("c", 1, "z")])):
        spark.createDataFrame([(None, p, s, 1, f) for p, s, f in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = incremental.ingest(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert sorted(r["fp"] for r in spark.read.parquet(f"{tmp_path}/index").collect()) == ["x", "y", "z"]
