import datetime as dt

from kgspark.streaming import stream
from pyspark.sql import functions as F


def test_stream_and_batch_agree(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, "view", float(i), t + dt.timedelta(minutes=17 * i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live.transform(lambda d: stream.tumbling(d, "1 hour", "10 days")).writeStream.format("memory").queryName("t1").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("t1")) == key(stream.tumbling(events, "1 hour"))
    assert stream.sessions(events, "1 hour").count() == 3
    assert stream.first_seen(events, ["user_id"]).count() == 3


def test_append_in_batches(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "node_id string, content string")
    nodes.write.parquet(str(tmp_path / "in"))
    seen = []
    live = spark.readStream.schema(nodes.schema).parquet(str(tmp_path / "in"))
    stream.appending(live, lambda df, k: seen.extend((k, r.node_id) for r in df.collect()), str(tmp_path / "c")).start().awaitTermination()
    assert sorted(seen) == [(0, "a"), (0, "b")]
    access = stream.accesses(spark.createDataFrame([("a", 1), ("a", 2)], "node_id string, ts int").withColumn("ts", F.timestamp_seconds("ts")))
    assert access.first().accesses == 2
