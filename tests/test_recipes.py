"""Recipes are written and read whole, in files whose number doesn't grow with that of the inputs."""

import glob
import os
import uuid

from pyspark.sql import functions as F

from chunkweave.functions.naming import recipe_name
from chunkweave.plans import corpus_queries as Q
from chunkweave.sources import readers, writers
from chunkweave.staging import staging

N = 60


def rows_of(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_round_trip_writes_few_files(spark, tmp_path):
    text = lambda i: "".join(f"{i % 7}.{k:07d} " for k in range(i * 30))
    docs = [(i, text(i), "en", "a%3D b", len(text(i))) for i in range(N)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    base = staging(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{base}/recipes-*"))
    got = rows_of(Q.QUERIES["s010_recipe_round_trip"](spark, str(tmp_path)), "path", "seq", "fp")
    assert got == rows_of(Q.Corpus(spark, str(tmp_path)).chunks, "path", "seq", "fp") and len({p for p, _, _ in got}) == N - 1
    (folder,) = set(glob.glob(f"{base}/recipes-*")) - before
    assert sum(len(f) for _, _, f in os.walk(folder)) < N


def test_folders_hold_the_texts_of_the_rows(spark, tmp_path):
    recipe = spark.createDataFrame([("a/x y.txt", k, f"{k % 3:040x}") for k in range(25)] + [("b/z", 0, "f" * 40)], "path string, seq long, fp string")
    writers.recipes(recipe, f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    assert {r["content"] for r in table.collect()} == {"".join(f"{k % 3:040x}\n" for k in range(25)), "f" * 40 + "\n"}
    want = rows_of(recipe.select(recipe_name(F.col("path")).alias("file"), "seq", "fp"), "file", "seq", "fp")
    assert rows_of(readers.recipes(spark, f"{tmp_path}/rows"), "file", "seq", "fp") == want
    writers.recipe_folders(table, f"{tmp_path}/folders")
    name = F.url_decode(F.regexp_extract("file", r"recipe_name=([^/]+)/", 1)).alias("file")
    assert rows_of(readers.recipe(spark, f"{tmp_path}/folders/*/*.txt").select(name, "seq", "fp"), "file", "seq", "fp") == want


def test_blank_lines_are_dropped(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame([("n", " a \r\n\n\tb\n \nc")], "recipe_name string, content string").write.parquet(path)
    assert [(s, f.strip()) for _, s, f in rows_of(readers.recipes(spark, path), "file", "seq", "fp")] == [(0, "a"), (1, "b"), (2, "c")]
