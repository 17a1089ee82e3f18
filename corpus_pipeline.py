"""A corpus pipeline of five stages, each one operator of tidemark.llm.

Each stage reads the documents that its predecessor wrote, decides over all of them and returns what it keeps with the
columns of documents; the last returns the encoded documents.

Defined results, in every stage: an empty table stays empty; columns beyond those of documents, whatever their names, are
kept (the last stage returns its own columns alone); rows that repeat are judged like any others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_tree, compact_windows, decontamination, quality_rules, simhash
from tidemark.llm.common import stored


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy rejects go. Null and empty texts have no words, so they go; ties don't arise."""
    return quality_rules.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Rows that repeat an id are told apart by their text; of rows that repeat both one stays. Rows without an id stay.
    """
    return simhash.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that near-duplicate an earlier passage are cut out; a document with nothing left goes.

    Texts too short for a passage, null texts and rows without an id stay as they are.
    """
    return compact_windows.cut(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Null and empty texts leak nothing; null and empty items are leaked by nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes; null and empty texts have none."""
    return bpe_tree.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rule_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL has neither the fingerprints nor the byte-pair merges; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
