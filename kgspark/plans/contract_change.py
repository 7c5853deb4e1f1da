"""Queries over changes: access, decay, retention, corrections, deduplication, streams' batch equivalents, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maintain, reflect, report, traverse
from ..schema import CONFIDENCE
from ..shared import table
from ..streaming import stream
from . import questions
from .registry import query

AS_OF = "2024-07-01 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"
_USERS_SQL = f"""u AS (SELECT user_id, max(ts) AS last, count(*) AS n, CASE WHEN user_id % 5 = 0 THEN min(ts) END AS until, {CONFIDENCE}::DOUBLE AS confidence FROM events GROUP BY user_id)"""
_DAYS = f"((epoch_ms({_NOW}) - epoch_ms(last)) / 86400000)"


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Users as nodes whose accesses are their events."""
    e = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.min("ts").alias("first"))
    return e.withColumn("until", F.when(F.col("user_id") % 5 == 0, F.col("first"))).withColumn("confidence", F.lit(CONFIDENCE))


@query(f"""WITH {_USERS_SQL} SELECT user_id, round(CASE WHEN {_DAYS} < 1 THEN 1.3 WHEN {_DAYS} < 7 THEN 1.1 ELSE 1.0 END::DOUBLE * CASE WHEN n > 10 THEN 1.2 WHEN n > 3 THEN 1.1 ELSE 1.0 END::DOUBLE * confidence * CASE WHEN until < {_NOW} THEN 0.3 ELSE 1.0 END::DOUBLE, 6) AS factor FROM u""")
def temporal_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    return users(spark, folder).select("user_id", F.round(traverse.temporal(F.col("last"), F.col("n"), F.col("confidence"), F.col("until"), now()), 6).alias("factor"))


@query(f"WITH {_USERS_SQL} SELECT user_id, round(CASE WHEN {_DAYS} > 7 THEN greatest(confidence * greatest(0.5, 1 - 0.01 * ({_DAYS} - 7)), 0.1) ELSE confidence END::DOUBLE, 6) AS confidence FROM u")
def decay_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return users(spark, folder).select("user_id", F.round(reflect.decayed(F.col("confidence"), F.col("last"), now()), 6).alias("confidence"))


@query("SELECT user_id AS node_id, count(*) AS accesses, max(ts) AS last_accessed_at FROM events GROUP BY user_id")
def access_delta(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("node_id"), "ts")
    return traverse.access_delta(e, F.col("ts"))


def _event_nodes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    no = F.lit(None).cast("timestamp")
    return e.select(F.col("event_id").alias("node_id"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("user_id") % 7 == 0, F.col("ts").cast("timestamp")).otherwise(no).alias("valid_until"), F.lit(CONFIDENCE).alias("confidence"), F.lit(None).cast("map<string,string>").alias("metadata"))


@query("""WITH cut AS (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) / 2)::TIMESTAMP AS c FROM events)
SELECT event_id AS node_id, CASE WHEN ts < c AND user_id % 7 <> 0 THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence, (ts < c AND user_id % 7 <> 0) AS forgotten FROM events, cut""")
def forget_before(spark: SparkSession, folder: str) -> DataFrame:
    """What was created in the first half of the time goes, but for what already expired."""
    nodes = _event_nodes(spark, folder)
    cut = nodes.agg(F.timestamp_seconds((F.unix_micros(F.min("created_at")) + F.unix_micros(F.max("created_at"))) / 2_000_000).alias("cut"))
    joined = nodes.crossJoin(F.broadcast(cut))
    out = maintain.forget_before(joined, F.col("cut"), F.lit("2100-01-01").cast("timestamp"))
    return out.select("node_id", F.col("confidence"), F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.lit("delete_reason")).alias("forgotten"))


@query("SELECT doc_id AS node_id, CASE WHEN contains(lower(text), 'license') THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence FROM documents")
def forget_topic(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    nodes = d.select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"), F.array().cast("array<string>").alias("entities"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit(CONFIDENCE).alias("confidence"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return maintain.forget_topic(nodes, "License", now()).select("node_id", "confidence")


_CHAIN_SQL = "pair AS (SELECT * FROM (SELECT doc_id AS old_id, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS new_id FROM documents) WHERE new_id IS NOT NULL)"


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("text").orderBy("doc_id")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("old_id"), F.lead("doc_id").over(w).alias("new_id")).where("new_id is not null")


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, walk AS (SELECT old_id, new_id, 1 AS steps FROM pair UNION ALL SELECT w.old_id, p.new_id, steps + 1 FROM walk w JOIN pair p ON p.old_id = w.new_id)
SELECT old_id, arg_max(new_id, steps) AS final_id, max(steps)::BIGINT AS steps FROM walk GROUP BY old_id""")
def supersede_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Copies as versions: each is replaced by the next; where every chain ends."""
    return maintain.chain_ends(_versions(spark, folder))


@query(f"WITH {_CHAIN_SQL} SELECT doc_id AS node_id, CASE WHEN old_id IS NULL THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM documents LEFT JOIN pair ON old_id = doc_id")
def supersede_confidence(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    nodes = d.select(F.col("doc_id").alias("node_id"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit(CONFIDENCE).alias("confidence"), F.lit(None).cast("map<string,string>").alias("metadata"))
    none = spark.createDataFrame([], "src long, dst long, type string, weight double, evidence string, ord long")
    return maintain.superseded(nodes, none, _versions(spark, folder), now())[0].select("node_id", "confidence")


@query("""SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_nationkey = 3 UNION SELECT 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3
UNION SELECT 'l' || l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 UNION SELECT 'n3'""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """All that a nation contains: customers, their orders, those's lines."""
    t = lambda n: table(spark, folder, n)
    name = lambda k, *c: F.concat(F.lit(k), F.concat_ws("-", *c))
    contains = t("customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    contains = contains.unionByName(t("orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    contains = contains.unionByName(t("lineitem").select(name("o", "l_orderkey").alias("src"), name("l", "l_orderkey", "l_linenumber").alias("dst")))
    root = spark.createDataFrame([("n3",)], "node_id string")
    nodes = contains.select(F.col("dst").alias("node_id"), F.lit(None).cast("string").alias("file"))
    return maintain.cascade(nodes, contains, root)


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS canonical FROM documents GROUP BY text HAVING count(*) > 1")
def dup_hash_groups(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.md5("text").alias("content_hash"), "doc_id")
    same = maintain.canonical(d, "doc_id", order="doc_id").join(d, "doc_id")
    return same.groupBy("content_hash", "canonical").agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def dedup_canonical(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return maintain.canonical(d, "doc_id", order="doc_id")


_NEXT_SQL = "e AS (SELECT * FROM (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents)"


@query(f"WITH {_NEXT_SQL} SELECT x.canonical AS src, y.canonical AS dst FROM e JOIN c x ON x.doc_id = src JOIN c y ON y.doc_id = dst WHERE x.canonical <> y.canonical")
def edge_remap(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    e = d.select(F.col("doc_id").alias("src"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("dst")).where("dst is not null")
    return maintain.remapped(e, dedup_canonical(spark, folder), ("src", "dst"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND text NOT IN (SELECT text FROM documents WHERE lang <> 'de')")
def append_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """The German documents as a batch that is appended to the others."""
    d = table(spark, folder, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"), F.lit(CONFIDENCE).alias("confidence"))
    return maintain.unseen(d.where("lang = 'de'"), d.where("lang != 'de'")).select("doc_id")


@query(f"""WITH {_USERS_SQL}, e AS (SELECT user_id FROM events WHERE value > 50)
SELECT count(*) AS nodes, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (until < {_NOW}) AS expired, count(*) FILTER (epoch_ms({_NOW}) - epoch_ms(last) > 30 * 86400000::BIGINT) AS stale,
round(avg(confidence), 6) AS confidence, count(*) FILTER (user_id NOT IN (SELECT user_id FROM e)) AS orphans FROM u""")
def health_report(spark: SparkSession, folder: str) -> DataFrame:
    nodes = users(spark, folder).select(F.col("user_id").alias("node_id"), "confidence", F.col("until").alias("valid_until"), F.col("last").alias("last_accessed_at"))
    e = table(spark, folder, "events").where("value > 50").select(F.col("user_id").alias("src"), F.col("user_id").alias("dst"))
    none = spark.createDataFrame([], "a long, b long")
    return report.health(nodes, e, none, now())


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.latencies(table(spark, folder, "events"), "event_type", "value")


@query("SELECT event_type AS type, (user_id % 2 = 0) AS abstention, count(*) AS n, count(*) FILTER (value > 50) AS correct, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS accuracy FROM events GROUP BY ROLLUP (type, abstention)")
def accuracy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    rows = e.select(F.concat(F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "_abs").otherwise("")).alias("question_id"), F.col("event_type").alias("type"), (F.col("value") > 50).alias("correct"))
    return report.accuracy(rows)


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS finish, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return stream.sessions(table(spark, folder, "events"), "1 hour")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stream.tumbling(table(spark, folder, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream.first_seen(table(spark, folder, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


ASKED = [
    ("How many bikes do I own?", "multi-session"), ("How many days ago did I buy the bike?", "temporal-reasoning"), ("Can you recommend a film for tonight?", "single-session-preference"),
    ("What is my current job?", "knowledge-update"), ("Remind me what the name of that book was", "single-session-assistant"), ("Which city was I born in?", "single-session-user"),
    ("What is the total of my expenses?", "multi-session"), ("When did I visit Lisbon?", "temporal-reasoning"), ("How often do I run?", "knowledge-update"),
]


@query(f"SELECT question, {questions.kind_sql('question')} AS kind FROM (SELECT * FROM (VALUES " + ", ".join(f"('{q}')" for q, _ in ASKED) + ") AS v(question) UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)")
def question_router(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(q,) for q, _ in ASKED], "question string")
    rows = rows.unionByName(table(spark, folder, "conversations").select(F.col("text").alias("question"))).unionByName(table(spark, folder, "benchmark").select(F.col("text").alias("question")))
    return rows.select("question", questions.kind(F.col("question")).alias("kind"))
