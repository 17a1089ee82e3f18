"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_tree, compact_windows, decontamination, hmm, quality_gbdt, quality_rules, sharding, simhash, suffix_dedup, token_counts
from tidemark.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), 24)


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_duplicate_passages(documents(spark, sf_dir))


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_weighted_hash_tree": sharding.ORACLE_SQL, "op6_rule_ledger": quality_rules.ORACLE_SQL}
