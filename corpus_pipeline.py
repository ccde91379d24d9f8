"""A five-stage corpus pipeline over documents, counted as part of quire.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Stages hand Python workers modest batches, and leave the session so. All but the last return the columns of docs, whatever further columns these hold.

Defined cases, beside those of the operators: an empty table stays empty, and the last stage gives no rows; null and empty
texts, and texts without a letter, go at the first stage; very long texts are taken whole; repeated rows are near copies
of each other; a null source is a source; without labelled languages the first stage keeps every text with a letter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_cnn_lang, chosen_path_join, curriculum_mix, decontaminate, token_store
from quire.llm.shared import clear, modest, remove, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language (score below 0.3), go; lang becomes the prediction.

    Nulls in any column: a null text goes, a null doc_id or source stays. Ties between languages go by name.
    """
    modest(spark)
    return byte_cnn_lang.accepted(docs, byte_cnn_lang.fit(docs), least=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id, of equal ones the smallest text hash.

    Repeated rows are one class. A text without words is near nothing but the same row repeated.
    """
    modest(spark)
    return chosen_path_join.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hit words go; documents of which half or more is hit go as a whole. An empty benchmark, or null items, hit nothing."""
    modest(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order. Texts without words take no part; a null source is the last."""
    return curriculum_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A store of token ids, and each document's place in it. Rows with one doc_id follow each other; a null doc_id is last."""
    modest(spark)
    return token_store.read(spark, token_store.write(docs))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't express the model, the join's runs or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again.

    What a stage has read, and its operators' intermediate tables, are deleted once its own rows are written. clear() is
    for one pipeline at a time in a session: it deletes all stored tables of the session's operators.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            clear(spark)
            if k:
                remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
