"""The ``opN_*`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe_counts, curves, digests, language, licenses, minhash, mixing, packing, toxicity, warc

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), fast_vocabulary=path("byte_bpe_50k.tiktoken"))


@register
def op1_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op2_bucket_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprint_documents(read(spark, sf_dir, "documents"))


@register
def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


@register
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@register
def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


@register
def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents"))


LLM_ORACLES["op8_raked_mixture"] = mixing.oracle_sql()
