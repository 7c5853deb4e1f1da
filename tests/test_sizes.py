"""Kinds by batches against kind(), and parts that grow with the input."""

from kgspark import shared
from kgspark.functions import text as X
from kgspark.plans import contract_graph
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
ODD = ["A licence is a permit.", "In 1999 it began, on 4 May.", "It was founded then", "It cost 5 % of $ 3", "I think we should claim this", "plain", "", None, "7 mil millón", "x" * 300 + " is a thing", "am 4 war es, 12.05.2020", "४ लाख 4 लाख"]


def test_kinds(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "id int, t string")
    df = df.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").cast("int").alias("id"), F.explode(X.sentences(F.col("text"))).alias("t")).limit(3000))
    df = df.withColumn("kind", X.kind(F.col("t")))
    got = X.kinds(df, "t").where("not (t <=> kind)").collect()
    assert not got
    assert "MapInArrow" in X.kinds(df, "t")._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_files(spark, monkeypatch):
    """A table sixty times as large came in as many parts, each sixty times as large."""
    monkeypatch.setattr(shared, "PART_BYTES", 4000)
    plain = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert shared.parts_of(plain) > 20 and shared.parts_of(spark.range(5)) == 4
    for name in ("neighbourhood_top8", "transitive_inference"):
        plan = getattr(contract_graph, name)(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert f", {shared.parts_of(plain)})" in plan
