"""The queries of this package: operator N as opN_<name>, each over its whole table, and the pipeline of corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, minhash_dedup, quality_rules, rp_forest, site_quality, source_mix, suffix_dedup, token_count, token_store, url_filter
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("n_lines", "n_stop_words", "failed_rules")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_frame(spark, url_filter.RULES))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(documents(spark, sf_dir))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(documents(spark, sf_dir), width=2, percent=80)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_quality_rules,
        op2_token_store,
        op3_source_mix,
        op4_rp_forest,
        op5_url_filter,
        op6_bpe_codec,
        op7_suffix_dedup,
        op8_minhash_dedup,
        op9_token_count,
        op10_site_quality,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op3_source_mix": source_mix.ORACLE, "op5_url_filter": url_filter.ORACLE}
