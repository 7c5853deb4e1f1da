"""The stages against plain loops over a small corpus with planted cases."""

import corpus_pipeline
import pyarrow as pa
from kgspark.llm import op1_secrets, op6_mixing, op7_decontaminate, op10_toxicity
from pyspark.sql import functions as F

from .conftest import prose
from .test_op7_decontaminate import brute as spans_of
from .test_op9_simhash import groups, missed_by_bands
from .test_op10_toxicity import corpus


def test_stages(spark, table, rng, tmp_path):
    rows, labels = corpus(rng, 200)
    item = prose(rng, 25)
    clean = [r for r, (_, y) in zip(rows, labels) if not y]
    rows += [(300, clean[0][1], "en", "src2"), (301, clean[1][1] + " tail", "en", "src3"), (302, " ".join([prose(rng, 60), item, prose(rng, 60)]), "de", "src0"), (303, item, "en", "src1"), (304, prose(rng, 50) + " AKIA" + "QRST2345" * 2, "en", "src5")]
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - y, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = {r.doc_id for r in op10_toxicity.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("toxic").collect()}
    assert {i for i, y in labels if y} - scored == set() and len(scored) <= 55
    left = [(r[0], r[1]) for r in rows if r[0] not in scored]
    label = groups(left)
    left = [x for k, x in enumerate(left) if label[k] == k]
    cut = []
    for i, text in left:
        found = spans_of([(i, text)], [(1, item)])
        words = len(text.split())
        inside = sum(b - a for _, _, a, b in found)
        if inside < op7_decontaminate.DROP_SHARE * words or not found:
            cut.append((i, " ".join(w for k, w in enumerate(text.split()) if not any(a <= k < b for _, _, a, b in found)) if found else text))
    sc = op1_secrets.scanner()
    for k, (i, text) in enumerate(cut):
        for _, a, b, name, _, _ in reversed(op1_secrets.finds([text], sc)):
            cut[k] = (i, f"{text[:a]}[SECRET:{name}]{text[b:]}")
    meta = {r[0]: r[2:] for r in rows}
    want = op6_mixing.mix(table([(i, t, *meta[i]) for i, t in cut]))
    key = lambda df: sorted((r.doc_id, " ".join(r.text.split()), r.mix_domain, r.mix_epoch, r.mix_tokens) for r in df.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = key(out)
    assert got == key(want)
    ids = {r[0] for r in got}
    assert not ids & scored and not ids & {300, 301, 303}
    assert out.where(F.contains("text", F.lit(item))).count() == 0


def test_stages_keep_the_columns(spark, table, tmp_path):
    docs = table([(1, "some words of a text"), (2, None)])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() == 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]


def tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_of_empty_tables(spark, table, tmp_path):
    tables(spark, tmp_path, table([(1, "x")]).limit(0), [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_domain", "mix_epoch", "mix_tokens"]


def test_run_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages."""
    tables(spark, tmp_path, odd, [(4, 1, 0), (None, None, 1), (5, None, None)], [(1, None), (None, ""), (2, "x y")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in odd.columns if c != "mix_epoch"] + ["mix_domain", "mix_epoch", "mix_tokens"]
    ids = {(r.doc_id, r.text and r.text[:8]) for r in out.collect()}
    rows = {(r.doc_id, r.text and r.text[:8]) for r in odd.collect()}
    assert ids <= rows and len(ids) >= 6


def test_near_copies_that_bands_miss(spark, table, rng, tmp_path):
    docs = table(missed_by_bands(rng))
    tables(spark, tmp_path, docs, [], [])
    first = set(range(0, 24, 2))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == first
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and got <= first


def test_batches_are_small(spark, table, tmp_path):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table([(1, "some words of a text"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    many = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('some words ', 300) text")  # 13 MB in one task
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    had = spark.conf.get(limit)
    try:
        for k in range(4):
            spark.conf.unset(limit)
            corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
            found = many.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in found) == 4000 and max(r.size for r in found) < 4 << 20
        for own, want in (("64m", 2 << 20), ("300k", 300 << 10)):  # a smaller limit of the session's own stays
            spark.conf.set(limit, own)
            corpus_pipeline.secrets(spark, table([(1, "x")]), str(tmp_path))
            found = many.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in found) == 4000 and want / 2 < max(r.size for r in found) < 1.1 * want
    finally:
        spark.conf.set(limit, had)
