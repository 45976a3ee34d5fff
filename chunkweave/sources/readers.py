"""Readers: each takes a session and a path (or lines) and returns a DataFrame."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.functions.naming import extension, glob_regex

FILEINFO_SCHEMA = (
    "format_version string, chunk_bytes int, chunking_method string, total_size long, uni_fingerprint array<string>, uni_size array<long>,"
    " files array<struct<path:string,chunk_ids:array<int>,chunk_sizes:array<long>,heat:double,heat_dsize:double>>"
)
# Fixed values of the formats.
FILEINFO_FORMATS = ("mean_go_v1", "dstp_fixed_go_v1", "fixed_go_v1")
FSL_MAGIC, FSL_VERSION = 0xDEADDEAD, 7
FSL_FIXED, FSL_VARIABLE = 1, 2
FSL_RANDOM, FSL_SIMPLE, FSL_RABIN = 1, 2, 3
#: Places in a hash trace: chunking method and parameters, hash bits, first file.
FSL_METHOD_AT, FSL_PARAMS_AT, FSL_BITS_AT, FSL_FILES_AT = 4120, 4124, 4172, 8296


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, skip_under: str | None = None, most: int | None = None) -> DataFrame:
    """Regular files below root: (path relative to root, size, content), filtered by suffix, globs on the base name and folder; the first `most` by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    rel = F.substring("path", len(base) + 2, 1 << 20)
    rows = rows.select(F.when(F.col("path") == base, F.element_at(F.split("path", "/"), -1)).otherwise(rel).alias("path"), F.col("length").alias("size"), "content")
    return filtered(rows, extensions, include, exclude, skip_under, most)


def filtered(rows: DataFrame, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, skip_under: str | None = None, most: int | None = None) -> DataFrame:
    """The filters of files() on any table with a path."""
    name = F.element_at(F.split("path", "/"), -1)
    if extensions:
        wanted = [e.strip().lower() if e.strip().startswith(".") else "." + e.strip().lower() for e in extensions if e.strip()]
        rows = rows.where(extension(F.col("path")).isin(wanted))
    if include:
        rows = rows.where(F.greatest(*(name.rlike(glob_regex(p)) for p in include), F.lit(False)))
    if exclude:
        rows = rows.where(~F.greatest(*(name.rlike(glob_regex(p)) for p in exclude), F.lit(False)))
    if skip_under:
        rows = rows.where(~F.col("path").startswith(skip_under.rstrip("/") + "/"))
    return rows.orderBy("path").limit(most) if most is not None else rows


def _matches(condition: Column, message: str) -> Column:
    return F.assert_true(condition, message).isNull()


def fileinfo(spark: SparkSession, path: str) -> DataFrame:
    """The nested catalog document, one row, checked: parallel arrays are equally long, ids in range, sizes positive."""
    rows = spark.read.schema(FILEINFO_SCHEMA).option("multiLine", "true").json(path)
    n = F.size("uni_fingerprint")
    sizes = F.forall("files", lambda f: (F.size(F.coalesce(f["chunk_sizes"], F.array().cast("array<bigint>"))) == 0) | (F.size(f["chunk_sizes"]) == F.size(f["chunk_ids"])))
    ids = F.forall("files", lambda f: F.forall(f["chunk_ids"], lambda c: (c >= 1) & (c <= n)))
    rows = rows.where(_matches(F.col("format_version").isin(*FILEINFO_FORMATS), "no known format_version"))
    rows = rows.where(_matches(n == F.size("uni_size"), "uni_fingerprint and uni_size differ in length"))
    rows = rows.where(_matches(sizes, "chunk_ids and chunk_sizes differ in length")).where(_matches(ids, "a chunk id is out of range"))
    return rows.where(_matches(F.forall("uni_size", lambda s: s > 0) & F.forall("uni_fingerprint", lambda f: F.trim(f) != ""), "a blank fingerprint or a size that isn't positive"))


def chunking_of(info: DataFrame) -> DataFrame:
    """info with chunking_method, inferred where the document has none."""
    inferred = F.when(F.col("format_version") == "mean_go_v1", "fastcdc").otherwise("fixed")
    return info.withColumn("chunking_method", F.coalesce("chunking_method", inferred))


def catalog_tables(info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """catalog_file, catalog_chunk and catalog_edge of fileinfo(); offsets are sums of the lengths before."""
    uni = info.select(F.posexplode(F.arrays_zip("uni_fingerprint", "uni_size")).alias("i", "u"))
    chunk = uni.select((F.col("i") + 1).cast("long").alias("chunk_id"), F.trim("u.uni_fingerprint").alias("fp"), F.col("u.uni_size").alias("size"))
    each = info.select(F.posexplode("files").alias("i", "f")).select((F.col("i") + 1).cast("long").alias("file_id"), "f.*")
    place = each.select("file_id", "path", F.posexplode(F.arrays_zip("chunk_ids", "chunk_sizes")).alias("seq", "c"))
    place = place.select("file_id", "path", F.col("seq").cast("long").alias("seq"), F.col("c.chunk_ids").cast("long").alias("chunk_id"), F.col("c.chunk_sizes").alias("given"))
    edge = place.join(chunk, "chunk_id").withColumn("length", F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("size")))
    before = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("file_id", "path", "seq", "chunk_id", "fp", "length").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    sums = edge.groupBy("file_id").agg(F.sum("length").alias("raw_size"), F.count("*").alias("n_chunks"))
    file = each.select("file_id", "path", "heat", "heat_dsize").join(sums, "file_id", "left").na.fill(0, ["raw_size", "n_chunks"])
    return file, chunk, edge


def trace_chunk_bytes(method: int, params: bytes) -> int:
    """Nominal chunk size from a trace's chunking method and its 44 bytes of parameters.

    Fixed: the first number. Variable: by the algorithm (first number) two to the power of the bits
    at 24, else half of what the least (at 36) and the largest size (at 40) make together; else 8192.
    """
    if method == FSL_FIXED:
        return struct.unpack_from("<I", params)[0]
    if method == FSL_VARIABLE and len(params) >= 44:
        algorithm, bits, low, high = (struct.unpack_from("<I", params, at)[0] for at in (0, 24, 36, 40))
        if algorithm in (FSL_RABIN, FSL_SIMPLE) and 0 < bits < 31:
            return 1 << bits
        if 0 < low <= high:
            return (low + high) // 2
    return 8192


def trace_records(data: bytes) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Path and (hash, size) of each chunk of every file of a binary hash trace."""
    magic, version, n_files = struct.unpack_from("<IIQ", data)
    if magic != FSL_MAGIC or version != FSL_VERSION:
        raise ValueError("not a hash trace of a known version")
    root = data[16 : 16 + 4096].split(b"\0")[0].decode(errors="replace")
    (method,), (hash_bits,) = (struct.unpack_from("<I", data, at) for at in (FSL_METHOD_AT, FSL_BITS_AT))
    nominal, width = trace_chunk_bytes(method, data[FSL_PARAMS_AT : FSL_PARAMS_AT + 44]), hash_bits // 8
    if width <= 0:
        raise ValueError("a trace without hashes")
    one = 4 * (method == FSL_VARIABLE) + width + 1  # size, hash, compression ratio
    at = FSL_FILES_AT
    for _ in range(n_files):
        chunks, path_len, target_len = struct.unpack_from("<QII", data, at + 80)
        at += 96
        path = data[at : at + path_len].decode(errors="replace").rstrip("\0")
        at += path_len + target_len
        if at + one * chunks > len(data):
            raise ValueError("a trace ends within a file")
        rows = []
        for k in range(at, at + one * chunks, one):
            size = struct.unpack_from("<I", data, k)[0] if method == FSL_VARIABLE else nominal
            rows.append((data[k + one - width - 1 : k + one - 1].hex(), size))
        at += one * chunks
        yield path.removeprefix(root).replace("\\", "/").lstrip("/"), rows


def traces(rows: DataFrame) -> DataFrame:
    """(source, path, seq, fp, length) of rows(path, content) of hash traces; one trace is one task, as its records have no index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["content"], strict=True):
                for name, chunks in trace_records(content):
                    if not chunks:
                        continue
                    yield pd.DataFrame({"source": source, "path": name, "seq": range(len(chunks)), "fp": [h for h, _ in chunks], "length": [n for _, n in chunks]})

    return rows.select("path", "content").mapInPandas(run, "source string, path string, seq long, fp string, length long")


def fsl(spark: SparkSession, path: str) -> DataFrame:
    return traces(spark.read.format("binaryFile").load(path))


def popularity(spark: SparkSession, path: str) -> DataFrame:
    """(file, heat) of a quoted CSV with a header; short rows are skipped, a heat that is no number raises."""
    rows = spark.read.schema("file string, heat string").csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE")
    return rows.where(F.col("file").isNotNull() & F.col("heat").isNotNull()).select(F.trim("file").alias("file"), F.trim("heat").cast("double").alias("heat"))


def recipe_lines(rows: DataFrame) -> DataFrame:
    """(file, seq, fp) of rows(file, value) of recipe texts: one fingerprint a line, blank lines dropped, order kept."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("file", F.posexplode(lines).alias("seq", "fp")).withColumn("seq", F.col("seq").cast("long"))


def recipe(spark: SparkSession, path: str) -> DataFrame:
    """recipe_lines() of text files, each a recipe."""
    return recipe_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value")))


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """recipe_lines() of recipe files kept as rows, by their names."""
    return recipe_lines(spark.read.schema("recipe_name string, content string").parquet(path).select(F.col("recipe_name").alias("file"), F.col("content").alias("value")))


def _node_text(value: Column) -> Column:
    """A JSON value as the text of a node reference: strings trimmed, numbers as integers, others null."""
    raw = F.trim(value)
    number = raw.try_cast("double")
    return F.when(raw.rlike(r'^".*"$'), F.trim(F.regexp_replace(raw, r'^"|"$', ""))).when(number.isNotNull(), number.cast("long").cast("string"))


def placement_json(spark: SparkSession, path: str) -> DataFrame:
    """(fp, node_ref) of a plain map or of one under hash2edge_node_id; blank keys and values of other kinds are dropped."""
    rows = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.hash2edge_node_id")
    text = F.coalesce(inner, F.col("value"))
    # values as they are written, so that strings, numbers and others can be told apart
    raw = rows.select(F.explode(F.from_json(text, "map<string,variant>")).alias("k", "v")).select("k", F.to_json("v").alias("v"))
    return raw.select(F.trim("k").alias("fp"), _node_text(F.col("v")).alias("node_ref")).where((F.col("fp") != "") & F.col("node_ref").isNotNull())


def placement_text(spark: SparkSession, path: str) -> DataFrame:
    """(fp, node_ref) of lines `fp node` or `fp,node`; # comments; a line with one field raises."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", r"#.*$", ""), ",", " "))
    rows = spark.read.text(path).select(F.split(line, r"\s+").alias("f"), line.alias("line")).where(F.col("line") != "")
    rows = rows.where(_matches(F.size("f") >= 2, "a placement line with less than two fields"))
    return rows.select(F.col("f")[0].alias("fp"), F.col("f")[1].alias("node_ref"))


def placement_folder(spark: SparkSession, path: str) -> DataFrame:
    """All placement files of a folder; of a fingerprint in more than one the last file by name counts."""
    parts = []
    for suffix, reader in ((".json", placement_json), (".txt", placement_text), (".csv", placement_text), (".tsv", placement_text), (".map", placement_text)):
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*{suffix}"))
        for status in found or []:
            name = status.getPath().toString()
            parts.append(reader(spark, name).withColumn("source", F.lit(name)))
    if not parts:
        return spark.createDataFrame([], "fp string, node_ref string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("fp").agg(F.max_by("node_ref", "source").alias("node_ref"))


def node_number(text: Column) -> Column:
    """12, 12.0, `12`, `edge12` and `cloud` (0) as a node number; null for others."""
    t = F.lower(F.trim(text))
    return F.when(t == "cloud", F.lit(0)).when(t.rlike("^edge[0-9]+$"), F.regexp_extract(t, "^edge([0-9]+)$", 1).try_cast("int")).otherwise(t.try_cast("double").cast("int"))


def global_index(spark: SparkSession, path: str) -> DataFrame:
    """(fp, node) of an index document: plain, under hash_to_node, or with node names; no file is an empty index."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "fp string, node int")
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.hash_to_node"), F.col("value"))
    rows = text.select(F.explode(F.from_json(inner, "map<string,string>")).alias("fp", "v"))
    return rows.select("fp", node_number(F.col("v")).alias("node")).where(F.col("node").isNotNull() & (F.trim("fp") != ""))


def request_fields(line: Column) -> tuple[Column, Column, Column]:
    """arrival_s, input and output of a request line: `in`, `in out`, `t in`, `t in out`, by tabs or else by white space."""
    text = F.trim(line)
    by = F.when(F.instr(text, "\t") > 0, F.transform(F.split(text, "\t"), lambda x: F.trim(x))).otherwise(F.split(text, r"\s+"))
    timed = (F.size(by) >= 2) & by[0].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    at = F.when(timed, 1).otherwise(0)
    return F.when(timed, by[0].try_cast("double")), F.get(by, at), F.coalesce(F.get(by, at + 1), F.lit(""))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """(arrival_s, input, output) of request lines; blank lines and # comments are skipped."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    arrival, source, target = request_fields(F.col("value"))
    return rows.select(arrival.alias("arrival_s"), source.alias("input"), target.alias("output"))


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """(arrival_s, input, output) of a trace of three tab-separated fields, by time."""
    rows = spark.read.schema("arrival_s double, input string, output string").csv(path, sep="\t", comment="#")
    return rows.where(F.col("input").isNotNull()).orderBy("arrival_s")


def stats_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def rates(spark: SparkSession, path: str, scale: float = 1000.0) -> DataFrame:
    """(path, rate): integers as they are, other numbers times scale, rounded up; a negative one raises."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "v"))
    whole = F.col("v").rlike(r"^[+-]?[0-9]+$")
    rows = rows.where(_matches(F.col("v").cast("double") >= 0, "a negative rate"))
    return rows.select("path", F.when(whole, F.col("v").try_cast("long")).otherwise(F.ceil(F.col("v").cast("double") * scale).cast("long")).alias("rate"))


def kept_assets(assets: DataFrame, extensions: list[str], least_bytes: int, most_per_repo: int) -> DataFrame:
    """assets(repo, name, size) of wanted suffixes and sizes, the largest of each repo."""
    rows = assets.where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$") & (F.col("size") >= least_bytes))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("size"), "name"))
    return rows.withColumn("n", nth).where(F.col("n") <= most_per_repo).drop("n")
