"""Candidates and their products by blocks against those of rows."""

import random

import pytest
from kgspark.functions.text import tokens_fold
from kgspark.operators import edges, index
from pyspark.sql import functions as F

FEW, MOST = 12, 4


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(r.choices(words[: r.choice((8, 40, 120))], k=r.randint(0, 25))) for _ in range(150)] + [None, ""] + ["same words here twice twice"] * 6
    docs = spark.createDataFrame([(k * 1000 + (k % 3), t, r.sample(["Ämter", "Amter", "Berg", "Tal", "Fluss", "See"], r.randint(0, 4)) or None) for k, t in enumerate(texts)], "ord long, content string, entities array<string>").cache()
    n = index.count_of(docs)
    inverse = index.inverse(index.frequencies(docs, key="ord"), n).cache()
    return docs, inverse, index.sent(inverse, n.first()[0]), index.weights(index.postings(docs, key="ord"), inverse)


def rows(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_candidates(parts, monkeypatch, sent):
    docs, _, table, w = parts
    monkeypatch.setattr(edges, "SENT_NODES", sent)
    got = edges.candidates_by_number(docs, table, max_df=FEW, most=MOST).select("a", F.posexplode("others").alias("rank", "b")).withColumn("rank", F.col("rank") + 1)
    want = edges.candidates(w.withColumnRenamed("ord", "k"), docs.select(F.col("ord").alias("k"), "ord"), FEW, MOST, "k")
    assert rows(got, "a", "b", "rank") == rows(want, "a", "b", "rank") and got.count() > 100


@pytest.mark.parametrize("block_words", [50_000_000, 150])
def test_products(parts, monkeypatch, block_words):
    """A node's terms and names went to each of its pairs: 50 times what is sent to each of a few blocks."""
    docs, inverse, table, w = parts
    monkeypatch.setattr(edges, "BLOCK_WORDS", block_words)
    words = inverse.agg(F.sum("df")).first()[0]
    lists = edges.candidates_by_number(docs, table, max_df=60, most=20)
    pairs = lists.select("a", F.posexplode("others").alias("rank", "b")).select("a", "b", (F.col("rank") + 1).alias("rank"))
    want = edges.pair_jaccard(edges.pair_cosine(pairs, w, "ord"), docs.where("entities is not null").select("ord", "entities"), "ord").where("cosine >= 0.3 or jaccard >= 0.2")
    got = edges.compared(lists, docs, table, words)
    assert rows(got, "a", "b", "rank", "cosine", "jaccard") == rows(want, "a", "b", "rank", "cosine", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))
    assert 50 < got.count() < pairs.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join [") <= 1 and "CoGroupsInArrow" in plan  # the one join is that of the last terms


def test_frequencies_above_a_byte(spark):
    docs = spark.createDataFrame([(1, "alpha " * 300 + "beta"), (2, "alpha beta"), (3, "beta " * 70000 + "alpha")], "ord long, content string")
    n = index.count_of(docs)
    table = index.sent(index.inverse(index.frequencies(docs, key="ord"), n), 3)
    got = index.packed(docs, table, tokens_fold, "ord").orderBy("ord").toArrow().combine_chunks()
    begin, place, freq = index.unpacked(got["terms"].chunk(0))
    assert begin.tolist() == [0, 2, 4, 6] and sorted(freq.tolist()) == [1, 1, 1, 1, 300, 70000] and sorted(place.tolist()) == [0, 0, 0, 1, 1, 1]
    assert got["top"].to_pylist() == [300, 1, 70000]
