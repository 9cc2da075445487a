"""The corpus pipeline: quality rules, exact and near dedup, mixing, tokenising.

Each stage takes what the one before it kept. All but the last return the columns of
documents; the last returns each document's id and tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import exact, mixing, quality_rules, sentencepiece, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_duplicates(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return sentencepiece.encoded(docs, model_path or public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", good),
    ("exact dedup", distinct),
    ("SimHash near-dedup", apart),
    ("mixing to target weights", mixture),
    ("SentencePiece", tokens),
]

#: SQL can't express the EM fit, XXH64 fingerprints, the random offsets or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, without the tables between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
