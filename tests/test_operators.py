import random

import pytest
from kgspark.functions import text as X
from kgspark.operators import community, edges, identity, index, maintain, reflect, report, retrieve
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens_fold, "The Café of Łódź, naïve 42!") == ["cafe", "odz", "naive", "42"]
    assert one(spark, X.tokens_unicode, "Müller a İstanbul 7") == ["müller", "i̇stanbul"]
    assert one(spark, X.tokens_fold, "") == [] and one(spark, X.tokens_fold, None) is None


def test_packing_is_that_of_a_loop(spark):
    rng = random.Random(1)
    for _ in range(5):
        parts = ["x" * rng.randrange(1, 300) for _ in range(rng.randrange(0, 12))]
        want, held = [], []
        for p in parts:
            held.append(p)
            if len(held) >= 3 or len(" ".join(held)) > 500:
                want.append(" ".join(held))
                held = []
        want += [" ".join(held)] if held else []
        assert one(spark, X.packed, parts, "array<string>") == want


def test_kinds(spark):
    cases = {"A node is a point of a graph": "definition", "The lab was founded by two people here": "event", "Sales rose 40% or so": "data-point", "According to them it rains": "claim", "Water runs": "fact"}
    for t, k in cases.items():
        assert one(spark, X.kind, t) == k


def test_entities(spark):
    got = one(spark, X.entities, 'We met Ada Lovelace in 1842 at NASA; see `foo_bar`, camelCase and "quoted words" (or so). Mail a.b@c.org, 5 kg, 30 EUR, 日本語')
    assert {"Ada Lovelace", "1842", "NASA", "foo_bar", "camelCase", "quoted words", "or so", "a.b@c.org", "5 kg", "30 EUR", "日本語"} <= set(got)
    assert len(got) == len(set(got))


def test_links_and_hash(spark):
    assert one(spark, X.links, "see [a](http://x) and [[Some Page]]") == ["http://x", "Some Page"]
    want = 5381
    for c in "hello é":
        want = (want * 33 + ord(c)) & 0xFFFFFFFF
    want -= (want >> 31) << 32
    digits, n = "", abs(want)
    while n:
        n, r = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    assert one(spark, X.compatible_hash, "hello é") == ("-" if want < 0 else "") + digits


def test_greedy_cap_is_that_of_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(20), rng.randrange(20, 40), "t", 0.5, o, r) for o in range(30) for r in range(1, 8)]
    degree, want = {}, []
    for a, b, *_ in rows:
        if degree.get(a, 0) < 10 and degree.get(b, 0) < 10:
            want.append((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame(rows, "a long, b long, type string, weight double, ord long, rank int")
    assert [(r.a, r.b) for r in edges.cap_greedy(df).collect()] == want


def test_contained_terms(spark):
    terms = spark.createDataFrame([("t1", "red apple tree house"), ("t2", "cat"), ("t3", "apple tree"), ("t4", "+-"), ("t5", "日本"), ("t6", "x"), ("t7", "")], "term_id string, term string")
    texts = spark.createDataFrame([("n1", "A Red Apple Tree House here"), ("n2", "concatenate"), ("n3", "apple trees"), ("n4", None), ("n5", "1+-2 in 大日本国 of xx")], "node_id string, content string")
    got = {(r.term_id, r.node_id) for r in edges.contained(terms, texts).collect()}
    assert got == {("t1", "n1"), ("t3", "n1"), ("t2", "n2"), ("t3", "n3"), ("t4", "n5"), ("t5", "n5"), ("t6", "n5")}


def test_label_propagation_of_two_cliques(spark):
    e = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(4) for j in range(i)] + [("x0", "y0", 0.1)]
    labels = {r.node_id: r.community for r in community.label_propagation(spark.createDataFrame(e, "a string, b string, weight double")).collect()}
    assert len({labels[f"x{i}"] for i in range(4)}) == 1 == len({labels[f"y{i}"] for i in range(4)}) and labels["x1"] != labels["y1"]
    nodes = spark.createDataFrame([(n, i, f"text {n}", ["Ada"]) for i, n in enumerate(labels)], "node_id string, ord long, content string, entities array<string>")
    made = community.community_nodes(spark.createDataFrame(list(labels.items()), "node_id string, community string"), nodes).collect()
    assert {r["size"] for r in made} == {4} and all(r.entities == ["Ada"] for r in made)


def test_synonyms_of_a_loop(spark):
    e = spark.createDataFrame([("n1", "n2", "similar-to", 0.6), ("n1", "n3", "shares-entity", 0.5), ("n2", "n3", "similar-to", 0.3), ("n1", "n2", "co-occurs", 0.9)], "a string, b string, type string, weight double")
    n = spark.createDataFrame([("n1", ["car", "bmw"]), ("n2", ["auto", "car"]), ("n3", ["auto"])], "node_id string, entities array<string>")
    assert {(r.term, r.synonym, r.weight) for r in identity.synonyms(e, n).collect()} == {("car", "auto", 1.1), ("bmw", "auto", 1.1), ("bmw", "car", 0.6)}


def test_contradictions(spark):
    pad = " in the long report of the Solar Union that was printed by the Astral Press of Geneva last autumn"
    texts = [(0, "Pluto Kuiper is a planet of our system" + pad), (1, "Officials wrote elsewhere: reclassified bodies such as Pluto Kuiper belong to dwarfs now, nobody minds" + " " * 3), (2, "Something else entirely, with no names whatsoever, of no use for anyone at all here")]
    n = spark.createDataFrame([(i, i, t, ["Pluto Kuiper", "Solar Union"] if i < 2 else ["Other"]) for i, t in texts], "node_id long, ord long, content string, entities array<string>")
    words = index.postings(n)
    w = index.weights(words, index.idf(words, index.count_of(n)))
    got = reflect.contradictions(n, w).collect()
    assert [(r.a, r.b, r.shared) for r in got] == [(0, 1, 2)]


def test_inferred_edges(spark):
    e = spark.createDataFrame([("a", "b", "causes", 0.9, 1), ("b", "c", "causes", 0.8, 2), ("b", "a", "causes", 0.9, 3), ("c", "d", "supports", 0.9, 4), ("b", "d", "causes", 0.2, 5)], "src string, dst string, type string, weight double, ord long")
    assert [(r.src, r.dst, round(r.weight, 3)) for r in reflect.inferred(e).collect()] == [("a", "c", 0.36)]


def test_maintenance(spark):
    nodes = spark.createDataFrame([("a", "f1", "h1", 1), ("b", "f1", "h2", 2), ("c", "f2", "h1", 3), ("d", None, "h4", 4)], "node_id string, file string, content_hash string, ord long")
    contains = spark.createDataFrame([("a", "c"), ("c", "a")], "src string, dst string")
    root = spark.createDataFrame([("b",)], "node_id string")
    assert {r.node_id for r in maintain.cascade(nodes, contains, root).collect()} == {"a", "b", "c"}
    same = maintain.canonical(nodes)
    assert {(r.node_id, r.canonical) for r in same.collect()} == {("a", "a"), ("b", "b"), ("c", "a"), ("d", "d")}
    e = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {tuple(r) for r in maintain.remapped(e, same, ("src", "dst")).collect()} == {("b", "a"), ("a", "d")}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old_id string, new_id string")
    assert {tuple(r) for r in maintain.chain_ends(pairs).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_retrieval(spark):
    seeds = spark.createDataFrame([("q", i, s, f, i) for i, (s, f) in enumerate([(0.9, "x"), (0.8, "x"), (0.7, "y"), (0.6, None), (0.5, "y")])], "question_id string, node_id long, score double, file string, ord long")
    assert [r.node_id for r in retrieve.diversified(seeds, 4).orderBy("rank").collect()] == [0, 2, 3, 1]
    rows = spark.createDataFrame([(1, "x" * 10), (2, "x" * 10), (3, "x")], "n long, content string")
    assert [r.n for r in retrieve.within_budget(rows, 15, [], ["n"]).collect()] == [1]
    chosen = spark.createDataFrame([("q", "b", 1.0)], "question_id string, node_id string, score double")
    turns = spark.createDataFrame([("a", "f", "User (turn 2)"), ("b", "f", "Assistant (turn 2)"), ("c", "f", "User (turn 1)")], "node_id string, file string, section string")
    assert [tuple(r) for r in retrieve.siblings(chosen, turns).collect()] == [("q", "a", 0.9)]
    d = spark.createDataFrame([("s", "b", "summarizes")], "src string, dst string, type string")
    both = spark.createDataFrame([("q", "b", 1.0), ("q", "s", 0.5)], "question_id string, node_id string, score double")
    assert {(r.node_id, r.score) for r in retrieve.without_repetition(both, d).collect()} == {("b", 0.5), ("s", 0.5)}


def test_reports(spark):
    r = spark.createDataFrame([(False, False, True, 1, 1), (False, True, False, 1, 1), (False, True, True, 2, 3), (True, True, True, 1, 1), (False, True, True, 1, 1)], "correct boolean, routed boolean, retrieved boolean, expected_count int, answered_count int")
    assert {tuple(x) for x in report.misses(r).collect()} == {("routing", 1), ("retrieval", 1), ("count", 1), ("other", 1)}
    n = spark.createDataFrame([("a", 1, "event", "Founded in 1999 by Ada", ["Ada"], 0.9, None), ("b", 2, "fact", "nothing", [], 0.9, None)], "node_id string, ord long, type string, content string, entities array<string>, confidence double, metadata map<string,string>")
    page = report.topic_page(n, "ada")
    assert [(x.node_id, x.at) for x in page.collect()] == [("a", 1999)]
    assert report.topic_markdown(page, "Ada").first().text == "# Ada\n\n## event\n- 1999: Founded in 1999 by Ada"
    assert [x.entity for x in report.coverage_gaps(n).collect()] == ["Ada"]


def test_nearest_of_equal_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(5)], "node_id long, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, vec array<double>")
    assert [r.node_id for r in retrieve.nearest(v, q, 2).collect()] == [0, 1]
    assert pytest.approx(1.0) == retrieve.nearest(v, q, 1).first().score


def test_rows_that_share_names(spark):
    rng = random.Random(3)
    rows = [(i, sorted({f"n{min(int(rng.expovariate(0.4)), 12)}" for _ in range(rng.randrange(0, 6))})) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, names array<string>")
    got = {(r.x, r.y, r.shared) for r in reflect.sharing(df, df).collect()}
    want = {(i, j, len(set(a) & set(b))) for i, a in rows for j, b in rows if i != j and len(set(a) & set(b)) >= 2}
    assert got == want and want


def test_new_contradictions(spark):
    pad = " and that is what the report of the harbour board said about it in the autumn"
    old = [("o1", "fact", "Mira Kovalenko works for the Delta Institute" + pad, ["Mira Kovalenko", "Delta Institute"]), ("o2", "fact", "Delta Institute stands" + pad, ["Delta Institute"])]
    new = [("n1", "fact", "Mira Kovalenko no longer works for the Delta Institute" + pad, ["Mira Kovalenko", "delta institute"]), ("n2", "fact", "Mira Kovalenko of the Delta Institute" + pad, ["Mira Kovalenko", "Delta Institute"]), ("n3", "fact", "short, no longer", ["Mira Kovalenko", "Delta Institute"])]
    schema = "node_id string, type string, content string, entities array<string>"
    got = reflect.new_contradictions(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert [tuple(r) for r in got] == [("n1", "o1", 2)]
