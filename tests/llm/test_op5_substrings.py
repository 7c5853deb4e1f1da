from collections import Counter, defaultdict

import numpy as np
import pytest
from kgspark.llm import op5_substrings as op
from kgspark.llm.words import words_of

from .conftest import prose


def brute(rows):
    places = defaultdict(list)
    for i, t in {(i, t) for i, t in rows if t is not None}:
        words = words_of(t)
        for p in range(len(words) - op.LENGTH + 1):
            places[tuple(words[p : p + op.LENGTH])].append((i, t, p))
    flagged = defaultdict(list)
    for group in places.values():
        if len(group) > 1:
            least = min((i is not None, i or 0) for i, _, _ in group)
            for i, t, p in group:
                flagged[i, t].append((p, least[1] if least[0] else None))
    out = []
    for (i, _), ps in flagged.items():
        runs = []
        for p, first in sorted(ps, key=lambda x: x[0]):
            if runs and p <= runs[-1][1] + op.LENGTH:
                runs[-1][1], runs[-1][2] = p, runs[-1][2] + 1
            else:
                runs.append([p, p, 1, first])
        out += [(i, a, b + op.LENGTH, n, first) for a, b, n, first in runs]
    return sorted(out, key=repr)


def corpus(rng):
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 120, 300)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (7, rows[5][1])]
    return rows + [(200, "la " * 120), (201, None), (202, ""), (203, "漢" * 60), (204, "漢" * 55)]


def test_cover():
    assert {(a - b) % op.PERIOD for a in op.COVER for b in op.COVER} == set(range(op.PERIOD))


@pytest.mark.parametrize("size", [op.BUCKET_CHARS, 3000])
def test_against_all_passages(table, rng, monkeypatch, size):
    monkeypatch.setattr(op, "BUCKET_CHARS", size)
    monkeypatch.setattr(op, "FLUSH", 500 if size < 10_000 else op.FLUSH)
    rows = corpus(rng)
    got = sorted((tuple(r) for r in op.spans(table(rows, clashes=True)).collect()), key=repr)
    assert got == brute(rows)


def test_odd_rows(odd):
    got = {r.doc_id for r in op.spans(odd).collect()}
    assert got == {4, 5}
    assert op.spans(odd.limit(0)).count() == 0


def test_a_passage_in_all_documents_stays_small(table, rng, monkeypatch):
    """Of a passage that all share, a hash's bucket gets one place from each task or bucket of documents, not one from each document."""
    monkeypatch.setattr(op, "BUCKET_CHARS", 20_000)
    passage = prose(rng, 130)
    rows = [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(300)]
    docs = table(rows).repartition(3)
    sizes, asked = [], iter(("hash is not null", "hash is not null", "false"))
    real = op.by_bucket

    def spied(df, buckets, schema, work):
        sizes.append([max(Counter(np.frombuffer(r.hash, np.uint64).tolist()).values()) for r in df.where(next(asked)).collect()])
        return real(df, buckets, schema, work)

    monkeypatch.setattr(op, "by_bucket", spied)
    got = sorted((tuple(r) for r in op.spans(docs).collect()), key=repr)
    assert got == brute(rows) and len(got) == 300
    assert max(sizes[0]) == 1 == max(sizes[1]) and len(sizes[1]) < 20_000
