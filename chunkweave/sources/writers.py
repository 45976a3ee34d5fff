"""Writers. All go through Spark's writers, whose commit makes a result visible as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.naming import object_candidates, recipe_name


def fileinfo(files: DataFrame, ids: DataFrame, edges: DataFrame, path: str, chunk_bytes: int, format_version: str = "mean_go_v1") -> None:
    """The nested catalog document, which by its format is one row: fit for a catalog that fits one machine."""
    fileinfo_row(files, ids, edges, chunk_bytes, format_version).write.mode("overwrite").json(path)


def fileinfo_row(files: DataFrame, ids: DataFrame, edges: DataFrame, chunk_bytes: int, format_version: str = "mean_go_v1") -> DataFrame:
    take = lambda rows, f: F.transform(F.array_sort(rows), lambda x: x[f])
    per = edges.groupBy("path").agg(F.collect_list(F.struct("seq", "chunk_id", "length")).alias("c"))
    none = F.array().cast("array<struct<seq:bigint,chunk_id:bigint,length:bigint>>")
    f = files.join(per, "path", "left").withColumn("c", F.coalesce("c", none))
    one = F.struct("path", F.transform(take(F.col("c"), "chunk_id"), lambda x: x.cast("int")).alias("chunk_ids"), take(F.col("c"), "length").alias("chunk_sizes"), "heat", "heat_dsize")
    docs = f.agg(F.array_sort(F.collect_list(F.struct("file_id", one.alias("f")))).alias("l"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("total_size"))
    uni = ids.agg(F.array_sort(F.collect_list(F.struct("chunk_id", "fp", "size"))).alias("u"))
    return docs.join(uni, F.lit(True)).select(
        F.lit(format_version).alias("format_version"), F.lit(chunk_bytes).alias("chunk_bytes"), "total_size",
        F.transform("u", lambda x: x["fp"]).alias("uni_fingerprint"), F.transform("u", lambda x: x["size"]).alias("uni_size"), F.transform("l", lambda x: x["f"]).alias("files"),
    )


def recipes(recipe: DataFrame, path: str) -> None:
    """Recipe files as rows (recipe_name, content), the content a fingerprint a line in order: files on disk don't grow with the number of inputs."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "fp"))), lambda x: F.concat(x["fp"], F.lit("\n")))
    rows = recipe.groupBy("path").agg(F.array_join(lines, "").alias("content"))
    rows.select(recipe_name(F.col("path")).alias("recipe_name"), "content").write.mode("overwrite").parquet(path)


def recipe_folders(recipes: DataFrame, path: str) -> None:
    """The texts of recipes(recipe_name, content) as files of their own, in one folder for each: for readers outside Spark, and for few recipes."""
    lines = F.split(F.regexp_replace("content", r"\n$", ""), "\n")
    rows = recipes.select("recipe_name", F.posexplode(lines).alias("seq", "value"))
    rows.repartition("recipe_name").sortWithinPartitions("recipe_name", "seq").select("recipe_name", "value").write.mode("overwrite").partitionBy("recipe_name").text(path)


def index(rows: DataFrame, path: str) -> None:
    """A node-local index in a folder of each node, or the global one if rows have no node-local location."""
    rows.write.mode("overwrite").partitionBy("node").parquet(path) if "location" in rows.columns else rows.write.mode("overwrite").parquet(path)


def blocks(chunks: DataFrame, path: str) -> None:
    """chunks(node, fp, data) by node and by the first two digits of the fingerprint."""
    chunks.withColumn("bucket", F.substring("fp", 1, 2)).repartition("node", "bucket").write.mode("overwrite").partitionBy("node", "bucket").parquet(path)


def containers(images: DataFrame, path: str) -> None:
    images.write.mode("overwrite").partitionBy("node").parquet(path)


def objects(files: DataFrame, existing: DataFrame | None, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    """Objects (object_name, content) to write for files(path, content), and counts of created, replaced and skipped ones."""
    named = files.select(object_candidates(F.col("path"), recipe_name(F.col("path")))[0].alias("object_name"), "content")
    known = named.withColumn("exists", F.lit(False)) if existing is None else named.join(existing.select("object_name", F.lit(True).alias("exists")), "object_name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    action = F.when(~F.col("exists"), "created").otherwise("replaced" if overwrite else "skipped")
    rows = known.withColumn("action", action)
    return rows.where("action <> 'skipped'").select("object_name", "content"), rows.groupBy("action").count()


def restored(files: DataFrame, path: str | None) -> None:
    """Restored files, or nothing kept if path is None."""
    files.write.format("noop").mode("overwrite").save() if path is None else files.write.mode("overwrite").parquet(path)


def stats(rows: DataFrame, path: str, by_node: bool = False) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy("node") if by_node else w).json(path)


def run_log(rows: DataFrame, path: str) -> None:
    """Appends runs as JSON lines and as CSV with the same columns."""
    rows.write.mode("append").json(f"{path}/jsonl")
    rows.write.mode("append").option("header", "true").csv(f"{path}/csv")


def csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def coverage(cover: DataFrame, path: str) -> None:
    """The report as JSON and its partial files as TSV with eight decimals."""
    cover.write.mode("overwrite").json(f"{path}/json")
    part = cover.where("class = 'partial'").select("path", "total_chunks", "edge_chunks", "total_bytes", "edge_bytes", F.format_string("%.8f", "edge_ratio").alias("edge_ratio"))
    part.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{path}/tsv")


def tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def placement(placed: DataFrame, settings: dict[str, str], path: str) -> None:
    """The placement document; a map in one row, by its format."""
    entries = placed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fp", "node")))).alias("hash2edge_node_id"))
    entries.select(*(F.lit(v).alias(k) for k, v in settings.items()), "hash2edge_node_id").write.mode("overwrite").json(path)
