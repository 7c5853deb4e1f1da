"""Evaluation: question sets, verdicts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_date

QUESTIONS = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def question_set(spark: SparkSession, path: str, types: list[str] | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """The questions of a file (a JSON array), of these types, a seeded sample of so many if there is a limit."""
    rows = spark.read.schema(QUESTIONS).json(path, multiLine=True)
    return sampled(rows if types is None else rows.where(F.col("question_type").isin(types)), "question_id", limit, seed)


def sampled(rows: DataFrame, key: str, limit: int | None, seed: int = 0) -> DataFrame:
    """A sample of so many rows that is the same on every run: the first by a seeded hash of the key."""
    return rows if limit is None else rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(limit)


def sessions(questions: DataFrame) -> DataFrame:
    """question_id, session, date, pos, role, content: the turns of all sessions of the questions."""
    s = questions.select("question_id", F.posexplode("haystack_sessions").alias("k", "turns"), "haystack_session_ids", "haystack_dates")
    own = s.select("question_id", F.element_at("haystack_session_ids", F.col("k") + 1).alias("session"), normal_date(F.element_at("haystack_dates", F.col("k") + 1)).alias("date"), F.posexplode("turns").alias("pos", "t"))
    return own.select("question_id", "session", "date", "pos", "t.role", "t.content")


def verdict(reply: Column) -> Column:
    """Whether a judge's reply means yes: it has the word, in any case."""
    return F.contains(F.lower(F.coalesce(reply, F.lit(""))), F.lit("yes"))


def node_types(chosen: DataFrame, types: list[str]) -> DataFrame:
    """question_id, and for each type how many of the question's nodes are of it. chosen: question_id, type."""
    return chosen.groupBy("question_id").pivot("type", types).agg(F.count(F.lit(1))).na.fill(0)


def count_errors(results: DataFrame) -> DataFrame:
    """type, n, mean and mean absolute difference of the number that was answered and the expected one. results: type, expected, answered."""
    gap = F.col("answered") - F.col("expected")
    own = results.where("expected is not null and answered is not null")
    return own.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("offset"), F.round(F.avg(F.abs(gap)), 6).alias("error"))


def missed_with(results: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """One row: misses, and of these how many had a node of the kind. results: question_id, correct; chosen: question_id, type."""
    had = chosen.where(F.col("type") == kind).select("question_id").distinct().withColumn("had", F.lit(True))
    return results.where("not correct").join(had, "question_id", "left").agg(F.count("*").alias("misses"), F.count_if(F.coalesce("had", F.lit(False))).alias("had"))
