"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    class_lm,
    decontam,
    divergence,
    fill_middle,
    license_scan,
    line_dedup,
    minhash,
    mixing,
    oracle,
    pq_dedup,
    quality,
    secret_scan,
    suffix_dedup,
    warc,
)
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_units(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("spans", spans)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(again, 256).alias("restored_sha256"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_bundles(warc.archive(spark, table(spark, sf_dir, "pages")))
    return found.select(
        "page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_licenses, op3_secrets, op4_near_duplicates, op5_mix, op6_substrings, op7_lines,
        op8_class_lm, op9_leaks, op10_embeddings, op11_divergence, op12_fill_middle, op13_warc,
    )
}

ORACLE_SQL = {
    "op4_near_duplicates": oracle.NEAR_DUPLICATES,
    "op5_mix": mixing.MIX_SQL,
    "op6_substrings": oracle.SUBSTRINGS,
    "op7_lines": oracle.LINES,
    "op10_embeddings": pq_dedup.LINKS_SQL,
    "op11_divergence": divergence.AUDIT_SQL,
    "op12_fill_middle": fill_middle.CUTS_SQL,
    "op13_warc": warc.RECORDS_SQL,
}
