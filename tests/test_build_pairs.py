"""A graph's undirected edges by blocks against those of rows."""

from kgspark.functions import text as X
from kgspark.operators import index
from kgspark.plans import build
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_undirected_edges(spark, monkeypatch):
    """Each node's terms went to each of its pairs; a graph of 0.1 GB did not end in time."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    sections = docs.select(F.concat_ws(":", "source", "doc_id").alias("file"), F.col("doc_id").cast("string").alias("doc_ord"), F.lit("Title").alias("doc_title"), F.lit(0).alias("sec_ord"), F.when(F.col("doc_id") % 3 == 0, "Public version").otherwise("").alias("title"), F.col("text").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))
    chunks = build.settled(build.chunk_nodes(build.numbered(sections), F.lit("2024-07-01").cast("timestamp")))
    own = build.terms(index.indexed(chunks), X.tokens_fold)
    rows = lambda: {(r.a, r.b, r.type, round(r.weight, 9), r.ord) for r in build.undirected_edges(chunks, own).collect()}
    got = rows()
    monkeypatch.setattr(build.Terms, "sent", lambda _: None)
    want = rows()
    assert got == want and len({r[2] for r in got}) > 1
