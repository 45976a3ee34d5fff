"""A training corpus from raw documents: five stages, each an operator of chunkweave.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Rows of docs may hold nulls in any column and may repeat; an empty
table goes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import langid, packing, secrets, simhash, substring_dedup
from chunkweave.llm._util import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cosine under which a text is like no language; one-word texts of the known ones reach 0.08.
LANGUAGE_LEAST = 0.05
#: Shingle length in words and similarity from which documents are near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing label becomes the predicted one."""
    prototypes = langid.train(docs.select("text", "lang"))
    said = langid.predict(docs.select(*COLUMNS), prototypes)
    kept = said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_LEAST))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return simhash.similar_documents(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILARITY)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has go; so do documents that have no word left."""
    found = substring_dedup.deduplicated(docs, ["lang", "source", "n_chars"])
    left = found.where("n_removed = 0 OR n_removed < n_words")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row for each document's piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, SimHash classes and tokenizer ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
