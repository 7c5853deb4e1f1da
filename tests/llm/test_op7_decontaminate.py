import pytest
from kgspark.llm import op7_decontaminate as op
from kgspark.llm.words import words_of

from .conftest import prose


def brute(docs, items, n=op.N, least=op.LEAST):
    out = set()
    for d, text in docs:
        words = words_of(text)
        for k, item in items:
            own = words_of(item)
            size = min(n, len(own))
            if size < least:
                continue
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
            hits = [p for p in range(len(words) - size + 1) if tuple(words[p : p + size]) in grams]
            runs = []
            for p in hits:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + size
                else:
                    runs.append([p, p + size])
            out |= {(d, k, a, b) for a, b in runs}
    return out


@pytest.mark.parametrize("most", [op.SET_CHARS, 200])
def test_against_all_windows(spark, table, rng, most):
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 5, 7, 8, 20, 60])] + [(9, None), (10, "")]
    docs = [(i, " ".join([prose(rng, 30), " ".join(rng.choice(items[:6])[1].upper().split()[rng.randrange(3) :]), prose(rng, 30)])) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.word_start, r.word_end) for r in op.spans(table(docs, clashes=True), bench, most=most).collect()}
    assert got == brute(docs, [x for x in items if x[1]])


def test_cut_and_drop(spark, table, rng):
    item, around = prose(rng, 20), [prose(rng, 40), prose(rng, 40)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table([(1, f"{around[0]} {item} {around[1]}"), (2, item + " end"), (3, around[0]), (3, around[0]), (4, None)], clashes=True)
    out = op.decontaminate(docs, bench)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 3, 4} and item not in rows[1].text and rows[1].text.startswith(around[0]) and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text == around[0] and out.count() == 4


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.decontaminate(odd, none).count() == odd.count() and op.spans(odd, none).count() == 0
    bench = spark.createDataFrame([(None, "漢字 カナ ไทย"), (1, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.spans(odd, bench).collect()} == {(6, None)}
    assert op.decontaminate(odd.limit(0), bench).count() == 0


def test_parts_of_the_benchmark_are_judged_together(spark, table, rng):
    items = [(i, prose(rng, 20)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts, _ = op.indexes(bench, op.N, op.LEAST, 200)
    assert parts > 3
    docs = [(i, f"{prose(rng, 10)} {' '.join(x for _, x in rng.sample(items, i % 4))} {prose(rng, 26)}") for i in range(40)]
    docs += [(100 + i, f"{prose(rng, 30)} {x[: len(x) // 2]} {items[5][1]} {x[len(x) // 2 :]} {prose(rng, 60)}") for i, x in items]
    docs = table([*docs, (200, None), (201, "")], clashes=True)
    rows = lambda most: sorted(map(repr, op.decontaminate(docs, bench, most=most).collect()))
    once = rows(op.SET_CHARS)
    assert rows(200) == once and 20 < len(once) < 50


def test_windows_that_many_items_share(spark, table, rng):
    frame = prose(rng, 12)
    items = [(i, f"{frame} {prose(rng, 10)}") for i in range(60)] + [(60, f"{frame} {frame}"), (61, frame)]
    docs = [(i, f"{prose(rng, 20)} {frame if i % 2 else items[i][1]} {prose(rng, 20)}") for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op.spans(table(docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.word_start, r.word_end) for r in found} == brute(docs, items) and len(found) >= 10 * 62
    texts = dict(docs)
    for r in found:
        assert words_of(texts[r.doc_id][r.char_start : r.char_end]) == words_of(texts[r.doc_id])[r.word_start : r.word_end]


def test_different_windows_of_one_hash_stay_apart(monkeypatch, rng):
    real = op.Words.windows
    monkeypatch.setattr(op.Words, "windows", lambda self, n: (real(self, n)[0], real(self, n)[1] >> op.U64(60) << op.U64(60)))
    items = [(i, prose(rng, 12)) for i in range(8)] + [(8, None)]
    index = op.build([x for x in items if x[1]])
    docs = [(i, f"{prose(rng, 15)} {items[i % 8][1]} {prose(rng, 5)}") for i in range(12)]
    for each in (True, False):
        got = {(d, index.ids[i] if each else None, a, b) for k, (d, t) in enumerate(docs) for _, i, a, b, _ in op.merged(op.hits(index, op.tokenize([t]), [t], each))}
        assert got == {(d, i if each else None, a, b) for d, i, a, b in brute(docs, items[:8])}
