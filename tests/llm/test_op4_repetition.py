from collections import Counter

from .conftest import prose
from kgspark.llm import op4_repetition as op
from kgspark.llm.words import words_of


def brute(text):
    words = words_of(text)
    total = sum(map(len, words))
    out = {}
    for n in [*op.TOP, *op.REPEATED]:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        if n in op.TOP:
            out[f"top_{n}"] = min(total, max([sum(map(len, g)) * c for g, c in seen.items() if c > 1], default=0))
        else:
            inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)}
            out[f"dup_{n}"] = sum(len(words[i]) for i in inside)
    lines = [x for x in (y.strip(" \t\r") for y in text.split("\n")) if x]
    seen = Counter(lines)
    return out, total, sum(len(x) for x in lines if seen[x] > 1), sum(map(len, lines))


def test_against_counting(rng):
    texts = ["", "a", "a a a a a a a", "x\ny\nx\n \nx", "é Ñ é ñ " * 9]
    for _ in range(30):
        piece = prose(rng, rng.randrange(1, 60))
        texts.append("\n".join([piece] * rng.randrange(1, 3) + [prose(rng, rng.randrange(0, 200))]))
    part, whole = op.measured(texts)
    for row, all_, t in zip(part, whole, texts):
        want, total, dup_lines, lines = brute(t)
        assert list(row[:-1]) == [want[c] for c in op.COLUMNS[:-1]] and all_[0] == total
        assert (row[-1], all_[-1]) == (dup_lines, lines)


def test_rules(table, rng):
    clean, junk = prose(rng, 400), "\n".join(["the same line of words again"] * 30)
    docs = table([(1, clean), (2, junk), (3, None), (4, "")], clashes=True)
    assert {r.doc_id for r in op.measures(docs).where("keep").collect()} == {1, 3, 4}
    assert {r.doc_id for r in op.keep_varied(docs).collect()} == {1, 3, 4} and op.keep_varied(docs).columns == docs.columns


def test_odd_rows(odd):
    assert op.measures(odd).count() == odd.count()
    assert op.keep_varied(odd.limit(0)).count() == 0 == op.measures(odd.limit(0)).count()
