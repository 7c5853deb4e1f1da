"""Words of batches against the analyzers, and what the index exchanges."""

import pyarrow as pa
import pytest
from kgspark.functions import text as X
from kgspark.operators import index
from kgspark.plans import contract_text
from pyspark.sql import functions as F

ODD = [
    "The Café of Łódź, naïve 42!", "", None, " a b ", "élève x́́y näive", "́", "İstanbul IĞDIR ısı ΣΑΣ", "日本語 テスト 한국어 हिन्दी", "a\nb\tcc\x0bdd\x1cee", "x_y-z's 3.14 ½ ²³ Ⅷ",
    "und und Haus haus HAUS", "🙂 smile🙂smile 𝔘𝔫𝔦 𐐀𐐁", "ab" * 5000 + " ab", "straße STRASSE ﬁn", "the of and", "last",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ascii-fold", "unicode", "locale-de", "locale-tr"])
def test_batches_have_the_analyzers_words(spark, name):
    analyzer = X.ANALYZERS[name]
    docs = spark.createDataFrame(list(enumerate(ODD * 3)), "node_id int, content string")
    own = lambda t: analyzer(t)  # noqa: E731  not known to the batches
    got = {(r.node_id, r.term, r.freq, r.term_idx, round(r.tf, 9)) for r in index.postings(docs, analyzer).collect()}
    want = {(r.node_id, r.term, r.freq, r.term_idx, round(r.tf, 9)) for r in index.postings(docs, own).collect()}
    assert got == want and len(got) > 30


def test_small_slices(spark, monkeypatch):
    before, words = X.batched(X.tokens_fold)
    low = pa.array([(t or "").lower() for t in ODD])
    whole = [(f + r, t, n) for f, found in words.batches(low) for r, t, n in zip(found.row.tolist(), found.terms().to_pylist(), found.freq.tolist())]
    monkeypatch.setattr("kgspark.functions.tokens.SLICE", 5)
    assert whole == [(f + r, t, n) for f, found in words.batches(low) for r, t, n in zip(found.row.tolist(), found.terms().to_pylist(), found.freq.tolist())]


def test_keys_with_several_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (1, "beta delta"), (None, "omega"), (None, "omega")], "node_id int, content string")
    got = {(r.node_id, r.term, r.freq) for r in index.postings(docs).collect()}
    assert got == {(1, "alpha", 1), (1, "beta", 2), (1, "delta", 1), (2, "gamma", 1), (None, "omega", 2)}
    assert {(r.term, r.df) for r in index.frequencies(docs).collect()} == {("alpha", 1), ("beta", 1), ("delta", 1), ("gamma", 1), ("omega", 1)}
    n = index.count_of(docs)
    inverse = index.inverse(index.frequencies(docs), n)
    assert {(r.node_id, r.term) for r in index.weighed(docs, inverse, 5).collect() if r.node_id} == {(1, "alpha"), (1, "beta"), (1, "delta"), (2, "gamma")}


@pytest.mark.parametrize("name", ["tokens_fold", "tokens_unicode", "tokens_locale_de"])
def test_words_are_counted_where_the_texts_are(spark, name):
    """A hash table of all words of a partition took memory that grew with the input."""
    assert "HashAggregate" not in plan_of(getattr(contract_text, name)(spark, "/root/testdata/sf0.001"))


def test_weights_need_no_exchange_of_postings(spark):
    docs = spark.createDataFrame([(k, f"alpha beta{k % 7} gamma{k % 3} delta{k} delta{k}") for k in range(60)], "node_id int, content string")
    inverse = index.inverse(index.frequencies(docs), index.count_of(docs))
    got = index.weighed(docs, inverse, 60)
    assert "Exchange" not in plan_of(got) and "Join" not in plan_of(got)
    plain = index.weights(index.postings(docs), inverse)
    lengths = {r.node_id: r.norm for r in index.norms(plain).collect()}
    want = {(r.node_id, r.term, r.df, round(r.weight, 9), round(lengths[r.node_id], 9)) for r in plain.collect()}
    rows = got.collect()
    assert {(r.node_id, r.term, r.df, round(r.weight, 9), round(r.norm, 9)) for r in rows} == want
    assert {(r.node_id, r.term) for r in index.weighed(docs, inverse, 60, below=60).collect()} == {(r.node_id, r.term) for r in rows if 1 < r.df < 60}
    assert {r.term for r in index.weighed(docs, inverse, 60, only=["alpha", "beta3", "none"]).collect()} == {"alpha", "beta3"}
    heaviest = index.weighed(docs, inverse, 60, most=1).collect()
    assert {(r.node_id, r.term) for r in heaviest} == {(k, f"delta{k}") for k in range(60)}
