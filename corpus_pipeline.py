"""A training corpus from the documents table: toxic documents out, one document of each near-duplicate group,
benchmark passages out, secrets redacted, sources mixed to target weights.

Each stage works on all rows that the one before kept, and hands on all columns.  Null and empty
texts pass every stage: they have no words, are nobody's copies and hold no secrets; mixing
counts them as one token.  Null ids are ordinary rows.  An empty documents table gives an
empty result with the columns of documents and those of the mixing.  Columns beyond those of
documents are handed on, whatever their names.  Rows that repeat are copies, of which one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import op1_secrets, op6_mixing, op7_decontaminate, op9_simhash, op10_toxicity
from kgspark.llm.common import shared_dir, small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier of the labels table rejects; without labels of both kinds all stay. Of the labels only those count whose documents are here."""
    small_batches(spark)
    return op10_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, nulls last; of equal ids by a hash of the text, then by all columns."""
    small_batches(spark)
    return op9_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark table cut out, documents that are mostly such removed; with an empty benchmark all stay as they are."""
    small_batches(spark)
    return op7_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials replaced by [SECRET:format]; no document goes."""
    small_batches(spark)
    return op1_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch that takes a document, with mix_domain, mix_epoch and mix_tokens: the stage that selects by target weights."""
    return op6_mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL cannot express the trained classifier, the fingerprints or the automata; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
