"""The queries of this subpackage for the driver, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_secrets, op2_pii, op3_warc, op4_repetition, op5_substrings, op6_mixing, op7_decontaminate, op8_tokens, op9_simhash, op10_toxicity
from .common import table


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secrets.scan(table(spark, sf_dir, "documents"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii.scan(table(spark, sf_dir, "documents"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc.round_trip(table(spark, sf_dir, "pages"))


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_repetition.measures(table(spark, sf_dir, "documents"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_substrings.spans(table(spark, sf_dir, "documents"))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(table(spark, sf_dir, "documents")).drop("text")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_tokens.sections(table(spark, sf_dir, "documents"), op8_tokens.VOCABULARY)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_simhash.removed(table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of", "group_size", "n_rows")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op10_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.where(F.col("toxic")).drop("toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets,
    "op2_pii": pii,
    "op3_warc": warc,
    "op4_repetition": repetition,
    "op5_substrings": substrings,
    "op6_mixing": mixing,
    "op7_decontaminate": decontaminate,
    "op8_tokens": tokens,
    "op9_simhash": near_duplicates,
    "op10_toxicity": toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": op3_warc.ROUND_TRIP_SQL,
    "op4_repetition": op4_repetition.MEASURES_SQL,
    "op5_substrings": op5_substrings.SPANS_SQL,
    "op6_mixing": op6_mixing.MIX_SQL,
    "op7_decontaminate": op7_decontaminate.SPANS_SQL,
}
