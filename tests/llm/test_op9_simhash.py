import itertools

import numpy as np
from kgspark.llm import bktree
from kgspark.llm import op9_simhash as op

from .conftest import prose


def test_trees_find_what_comparing_finds():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 62, (200, 4)).astype(np.uint64)
    fps[50:] = fps[rng.integers(0, 50, 150)]
    for row in fps[50:]:
        for bit in rng.integers(0, 256, rng.integers(0, 60)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    group = np.sort(rng.integers(0, 3, 200))
    forest = bktree.build(fps, group)
    q, item, d = bktree.search(forest, fps, forest.root, 40)
    want = {(i, j) for i in range(200) for j in range(200) if group[i] == group[j] and bktree.distance(fps[i], fps[j]) <= 40}
    assert set(zip(q.tolist(), item.tolist())) == want and (d == bktree.distance(fps[q], fps[item])).all()


def groups(rows, radius=op.RADIUS):
    fp, some = op.fingerprints([t for _, t in rows])
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if some[i] and some[j] and bktree.distance(fp[i], fp[j]) <= radius:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def corpus(rng, n=60):
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(60, 200))
        rows.append((3 * i, text))
        for k in range(1, rng.randrange(0, 3)):
            words = text.split()
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = "changed"
            rows.append((3 * i + k, " ".join(words)))
    return rows


def test_against_all_pairs(table, rng):
    rows = corpus(rng)
    label = groups(rows)
    want = {rows[i][0] for i, r in enumerate(label) if r != i}
    got = {r.doc_id for r in op.removed(table(rows, clashes=True)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_one_of_each_group_stays(table, rng):
    rows = corpus(rng, 20) + [(500, "same text of words"), (500, "same text of words"), (501, "same text of words"), (None, "same text of words"), (502, None), (502, None), (503, ""), (504, "")]
    docs = table(rows, clashes=True)
    out = op.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(500) == 1 and 501 not in kept and None not in kept and kept.count(502) == 2 and {503, 504} <= set(kept)
    assert len(kept) == len(rows) - sum(r.n_rows for r in op.removed(docs).collect())


def test_reference_by_broadcast_trees(table, rng):
    rows = corpus(rng, 25)
    docs = table(rows)
    fp, _ = op.fingerprints([t for _, t in rows])
    want = {(a[0], b[0]) for (i, a), (j, b) in itertools.product(enumerate(rows), enumerate(rows)) if bktree.distance(fp[i], fp[j]) <= op.RADIUS}
    assert {(r.doc_id, r.reference_id) for r in op.search_reference(docs, docs).collect()} == want


def test_odd_rows(odd):
    got = {(r.doc_id, r.duplicate_of, r.n_rows) for r in op.removed(odd).collect()}
    assert got == {(5, 4, 2)}
    assert op.keep_one(odd).count() == odd.count() - 2
    assert op.keep_one(odd.limit(0)).count() == 0 == op.removed(odd.limit(0)).count()


def flipped(rng, fps, k):
    out = fps.copy()
    for row in out:
        for bit in rng.choice(256, k, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


def test_recall_at_the_radius_at_every_size():
    rng = np.random.default_rng(4)
    for n in (1_000, 1 << 20, 1 << 25, 1 << 30):
        at = op._positions(*op.plan_bands(n))
        fps = rng.integers(0, 1 << 63, (600, 4)).astype(np.uint64)
        met = (op.band_keys(fps, at) == op.band_keys(flipped(rng, fps, op.RADIUS), at)).any(axis=1)
        assert met.mean() >= 0.87, (n, met.mean())  # 0.9 within three standard errors
        assert (op.band_keys(fps, at) == op.band_keys(flipped(rng, fps, 20), at)).any(axis=1).mean() > 0.99


def test_large_trees_have_the_components_of_all_pairs():
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    fps = np.concatenate([flipped(rng, np.repeat(seeds[k : k + 1], m, axis=0), d) for k, (m, d) in enumerate([(700, 12), (150, 19), (90, 60), (1, 0), (30, 21)])])
    fps = np.concatenate([fps, flipped(rng, seeds[:1], 45), flipped(rng, fps[-20:], 30)])
    fps = fps[rng.permutation(len(fps))]
    got = bktree.components(bktree.build(fps, np.zeros(len(fps), int)), 40)
    want = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 40
    for _ in range(len(fps)):
        new = np.where(near, want[None], len(fps)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (got == want).all() and 5 < len(set(want)) < 150


def test_row_that_stays_among_equal_ids_and_texts(spark):
    rows = [(1, "some words of a text", "b"), (1, "some words of a text", "a"), (1, "some words of a text", None), (2, "some words of a text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    for k in (1, 3):
        assert [tuple(r) for r in op.keep_one(docs.repartition(k)).collect()] == [(1, "some words of a text", "a")]


def missed_by_bands(rng, n=12):
    """Texts in pairs of which bands of so many texts link none, though each is within the radius."""
    at = op._positions(*op.plan_bands(2 * n))
    rows = []
    while len(rows) < 2 * n:
        words = prose(rng, 120).split()
        other = words.copy()
        for _ in range(rng.randrange(8, 40)):
            other[rng.randrange(len(other))] = prose(rng, 1) + "x"
        pair = [" ".join(words), " ".join(other)]
        fp, _ = op.fingerprints(pair)
        keys = op.band_keys(fp, at)
        if bktree.distance(fp[0], fp[1]) <= op.RADIUS and not (keys[0] == keys[1]).any():
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    return rows


def test_links_that_bands_miss(table, rng):
    rows = missed_by_bands(rng)
    rows += [(100 + i, t) for i, t in corpus(rng, 20)]
    label = groups(rows)
    want = {(rows[i][0], rows[r][0]) for i, r in enumerate(label) if r != i}
    assert {(k + 1, k) for k in range(0, 24, 2)} <= want
    assert {(r.doc_id, r.duplicate_of) for r in op.removed(table(rows)).collect()} == want


def test_links_over_several_blocks(table, rng, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 10)
    rows = missed_by_bands(rng)
    want = {(k + 1, k) for k in range(0, 24, 2)}
    assert {(r.doc_id, r.duplicate_of) for r in op.removed(table(rows)).collect()} == want


def test_exact_search_finds_what_comparing_finds(monkeypatch):
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    fps = np.concatenate([fps, *(flipped(rng, fps[:100], k) for k in (38, 40, 41)), flipped(rng, np.repeat(fps[:1], 200, axis=0), 12)])
    label = np.arange(len(fps)) * 7
    label[600:] = label[0]  # a family that is one component already
    for full in (op.FULL, 3):
        monkeypatch.setattr(op, "FULL", full)
        for n, radius in ((800, 40), (200_000, 40), (10**6, 40), (800, 0), (800, 5), (10**6, 5), (800, 90)):
            parts = op.plan_parts(n, radius)
            assert sum(max(m.bit_count() for m in masks.tolist()) + 1 for _, masks in parts) == radius + 1
            near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= radius
            want = {(label[i], label[j]) for i, j in zip(*np.nonzero(near)) if label[i] < label[j]}
            assert set(map(tuple, op.across(fps, label, None, None, parts, radius).tolist())) == want
            want = {tuple(sorted((label[i], label[350 + j]))) for i, j in zip(*np.nonzero(near[:350, 350:])) if label[i] != label[350 + j]}
            assert set(map(tuple, op.across(fps[:350], label[:350], fps[350:], label[350:], parts, radius).tolist())) == want
