"""Corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, minhash, mixing, quality, secret_scan
from tessella.llm.common import keep, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on the labelled ones among docs, rejects.

    Null texts are judged as empty ones; repeated rows share their fate; without labels all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word shingle similarity of 0.8 or more.

    Of repeated rows one stays. Null texts, texts without words and rows without doc_id all stay.
    """
    return minhash.keep_one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that give benchmark items away.

    Null and empty texts stay; repeated rows share their fate; an empty benchmark drops nothing.
    """
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Null and empty texts stay as they are."""
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources get equal shares, and shuffles the copies.

    Null sources form a source of their own; rows that share a doc_id get the same count.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The stages learn models and follow graphs, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read again.

    Each stage takes empty tables, which give no rows, and columns beyond those of documents.
    """
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"{folder}/stage{i}")
    return docs
