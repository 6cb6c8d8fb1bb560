"""Queries of the operators over the tables, with the parameters meant for production, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import countmin, euclid, exact_dedup, fuzzylines, interpolation, jaccard, langid, mixing, pieces, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclid.links(_table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.passages(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(_table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.repeats(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_suffix_array": op6_suffix_array,
    "op7_language_id": op7_language_id,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {"op3_embedding_near_dedup": euclid.sql(), "op4_substring_dedup": countmin.sql(), "op6_suffix_array": countmin.sql(suffixes.LENGTH), "op1_mixing": mixing.sql(), "op9_ngram_jaccard": jaccard.sql(), "op10_exact_dedup": exact_dedup.SQL}
