"""The queries of this subpackage by name, each over the whole documents table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelace.llm import language, mixing, negatives, packing, privacy, quality, secrets, sharding, simhash, spelling, substring, tiff, tokens
from tracelace.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rules")
    return quality.judge(documents(spark, sf_dir)).select(*columns)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(documents(spark, sf_dir))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_secret_scans": op4_secret_scans,
        "op5_language_id": op5_language_id,
        "op6_mix_sources": op6_mix_sources,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_media_tiff": op9_media_tiff,
        "op10_shard_documents": op10_shard_documents,
        "op11_private_data": op11_private_data,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.SQL,
        "op4_secret_scans": secrets.SQL,
        "op6_mix_sources": mixing.SQL,
        "op10_shard_documents": sharding.sql(),
        "op12_spelling_variants": spelling.SQL,
        "op13_hard_negatives": negatives.SQL,
    }
