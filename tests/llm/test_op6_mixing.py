import duckdb
import pytest
from kgspark.llm import op6_mixing as op
from pyspark.sql import functions as F

from .conftest import prose


def test_against_sql_and_budgets(spark, table, rng, tmp_path):
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", "src2", "src7", None])) for i in range(400)]
    docs = table(rows)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(f"select doc_id, mix_domain, mix_epoch, mix_tokens from ({op.MIX_SQL})").fetchall()
    got = [tuple(r) for r in op.mix(docs).select("doc_id", "mix_domain", "mix_epoch", "mix_tokens").collect()]
    assert sorted(got) == sorted(want)
    plan = op.budgets(op._keyed(docs)).collect()
    total = sum(p.tokens for p in plan)
    assert abs(sum(p.budget for p in plan) - int(total * op.SHARE)) <= len(plan)
    assert all(p.budget <= p.tokens * op.MAX_EPOCHS for p in plan)


def test_prefix_of_each_leaf(table, rng):
    docs = table([(i, "one two three", "en", "src1") for i in range(300)])
    out = op.mix(docs)
    assert abs(out.count() - 240) <= 1 and out.groupBy("doc_id").count().where("count > 1").count() == 0


def test_odd_rows(odd):
    out = op.mix(odd)
    assert out.columns == [c for c in odd.columns if c != "mix_epoch"] + ["mix_domain", "mix_epoch", "mix_tokens"]
    assert out.count() > 0
    assert op.mix(odd.limit(0)).count() == 0


def test_null_and_equal_ids_are_a_fair_sample(table, rng):
    for doc_id in (None, 7):
        rows = [(doc_id, " ".join(["w"] * rng.randrange(1, 200)) + f" {k}", "en", "src1") for k in range(2_000)]
        mean = sum(len(t.split()) for _, t, *_ in rows) / len(rows)
        out = op.mix(table(rows), share=0.5).collect()
        assert abs(sum(r.mix_tokens for r in out) / len(out) - mean) < 8 and max(r.mix_tokens for r in out) > 190


def test_weights_and_domains_are_arguments(spark, table):
    rows = [(i, "one two three four", lang, source) for i, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("de", "a"), (None, "c")] * 100)]
    docs = table(rows)
    weights = op.weights_of(spark.createDataFrame([("x", None, None, 3.0), ("y", None, None, 1.0), ("x", "en", None, 2.0), ("*", "en", "b", 5.0)], "domain string, lang string, source string, weight double"))
    assert weights == {("x",): 3.0, ("y",): 1.0, ("x", "en"): 2.0, ("*", "en", "b"): 5.0}
    domain = F.when(F.col("source") == "c", "y").otherwise("x")
    got = {tuple(r[:3]): r.budget for r in op.budgets(op._keyed(docs, domain), 0.5, 1, weights).collect()}
    # 800 of 1600 tokens: x has 600, y 200; of x en has 400 and de 200; of en b has 5 of 6 parts
    assert got == {("y", "none", "c"): 200, ("x", "de", "a"): 200, ("x", "en", "b"): 333, ("x", "en", "a"): 66}
    out = op.mix(docs, 0.5, 1, weights=weights, domain=domain)
    assert {r.mix_domain for r in out.collect()} == {"x", "y"} and abs(out.where("source = 'b'").count() - 84) <= 1
    with pytest.raises(ValueError):
        op.weights_of(spark.createDataFrame([("x", None, None, 0.0)], "domain string, lang string, source string, weight double"))
