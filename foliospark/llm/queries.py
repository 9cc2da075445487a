"""The corpus operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact, langid, lm_score, mixing, pii, quality_rules, sentencepiece, simhash, site_quality, token_counts
from .common import documents


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=3, seed=42)
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return sentencepiece.encoded(documents(spark, sf_dir), model_path or public_tokenizers.path("piece_bpe_32k.model"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables are invented, so a key that all may know does where none is set.
    return pii.pseudonymised(documents(spark, sf_dir), os.environ.get(pii.KEY_VARIABLE, "not secret").encode())


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_site_quality": op6_site_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_token_counts": op10_token_counts,
}

#: SQL can't express XXH64 (1), the random offsets (2) or the EM fit (7).
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from n""",
}
