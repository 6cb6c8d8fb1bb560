"""Documents to tokens: language ID, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import exact_dedup, jaccard, langid, mixing, pieces, store


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay (operator 7).

    Null and empty texts have no language and go; a text that one language fits
    at least as well as all others together stays, however short or long; equal
    rows share their fate; columns are carried along, and a null lang becomes
    the language found. An empty table, or one without any language to learn
    from, gives an empty one.
    """
    return langid.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays (operator 10): that of least doc_id, null ids last, of equal ids one; null texts all stay, empty ones are equal; other columns, whatever their names, are carried along."""
    return exact_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 9): that of least doc_id, null ids last; texts without words have no partner and stay; other columns, whatever their names, are carried along. doc_id is an integer."""
    return jaccard.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each leaf up to its budget, by epochs (operator 1); a document that several epochs use is repeated, null and empty texts are never used, a null lang or source is a leaf of its own, ties of order go by doc_id, then text; other columns are carried along."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every document (operator 2), a row a row; the ids of a null text are null, those of an empty one none; equal rows get equal ids; other columns end here."""
    return pieces.tokenized(docs)


STAGES = [("language_id", identify), ("exact_dedup", dedup), ("ngram_jaccard", near_dedup), ("mixing", mix), ("sentencepiece", encode)]

#: Language ID and merge-dropout have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
