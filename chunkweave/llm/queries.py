"""The opN_<name> queries: each derives its contract's columns from an operator of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkweave.llm import ann, cdc_fingerprint, langid, packing, secrets, sentencepieces, simhash, substring_dedup, token_store, warc
from chunkweave.llm._util import staging, table


def op1_cdc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging(spark)}/store-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_store.read(spark, path)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cdc_fingerprint": op1_cdc_fingerprint,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nn_descent": op4_nn_descent,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc": op6_warc,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_store": op8_token_store,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {"op9_secret_scan": secrets.ORACLE}
