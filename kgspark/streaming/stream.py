"""Structured Streaming forms of what the graph does over time; each works on batch tables alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, finish, n: events of a user that follow each other within the gap. Late events are waited for by the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """start, event_type, n, total in windows of a width."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen before, within the watermark of a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def accesses(events: DataFrame) -> DataFrame:
    """node_id, accesses, last_accessed_at: to be written in update mode."""
    return events.groupBy("node_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_accessed_at"))


def appending(nodes: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that gives each batch of a stream of nodes to append once for each id; started by the caller. The id makes a repeated batch known."""
    return nodes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def retained(nodes: DataFrame, time: str, before: str, as_of: str) -> DataFrame:
    """Retention as a stream's projection: content older than a time is given an end and little confidence as it passes. nodes: confidence, valid_until, time."""
    old = F.col(time) < F.lit(before).cast("timestamp")
    return nodes.withColumn("valid_until", F.when(old & F.col("valid_until").isNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("valid_until"))).withColumn("confidence", F.when(old, F.least("confidence", F.lit(0.1))).otherwise(F.col("confidence")))


def on_schedule(nodes: DataFrame, change: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that applies a change, such as decay, to what has come since the last run, and ends: a job for a scheduler."""

    def run(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return nodes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
