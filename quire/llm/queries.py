"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_cnn_lang, chosen_path_join, curriculum_mix, decontaminate, html_consensus, license_scan, rare_digest, substring_dedup, token_store, toxicity_ordinal
from quire.llm.shared import docs_of


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(docs_of(spark, sf_dir, "doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(docs_of(spark, sf_dir, "doc_id", "text")).drop("kept_text")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(spark, token_store.write(docs_of(spark, sf_dir, "doc_id", "text")))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path_join.classes(docs_of(spark, sf_dir, "doc_id", "text")).drop("key", "root")


def op7_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_digest.fingerprints(docs_of(spark, sf_dir, "doc_id", "text"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix.mixture(docs_of(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.hits(docs_of(spark, sf_dir, "doc_id", "text"), benchmark).drop("items", "hit")


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir, "doc_id", "text")
    return toxicity_ordinal.graded(docs, toxicity_ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir, "doc_id", "text", "lang")
    return byte_cnn_lang.identified(docs, byte_cnn_lang.fit(docs)).drop("windows")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_html_consensus, op4_toxicity, op5_token_store, op6_chosen_path_join, op7_rare_digest, op8_curriculum_mix, op9_decontaminate, op10_language_id)}
