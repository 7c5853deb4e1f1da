import pytest
from kgspark.llm import op8_tokens as op

from .conftest import prose


@pytest.fixture(scope="module")
def codec():
    return op.encoding(open(op.VOCABULARY, "rb").read())


def brute(text, enc, sizes, rule):
    data, sections = text.encode(), []
    at = 0
    for line in data.split(b"\n"):
        sections.append((at, at + len(line) + 1))
        at += len(line) + 1
    sections[-1] = (sections[-1][0], len(data))
    if len(sections) > 1 and sections[-1][0] == sections[-1][1]:
        sections.pop()
    counts = [0] * len(sections)
    at = 0
    for t in enc.encode_ordinary(text):
        end = at + sizes[t]
        shares = [max(0, min(end, b) - max(at, a)) for a, b in sections]
        touched = [i for i, s in enumerate(shares) if s]
        counts[{"first": touched[0], "last": touched[-1], "most": shares.index(max(shares))}[rule]] += 1
        at = end
    return [(len(data[:a].decode()), len(data[:b].decode()), n) for (a, b), n in zip(sections, counts)]


@pytest.mark.parametrize("rule", op.RULES)
def test_against_a_loop(codec, rng, rule):
    texts = ["", "\n", "\n\n\n\n", "a\n", "\n\n\n  b", "é\n漢字🎉\r\n\t\n", "<|endoftext|>\nx"] + ["\n".join(prose(rng, rng.randrange(0, 12)) + " " * rng.randrange(3) for _ in range(8)) for _ in range(20)]
    doc, _, a, b, n, _ = op.counted(texts, *codec, rule)
    got = [[] for _ in texts]
    for d, *x in zip(doc.tolist(), a.tolist(), b.tolist(), n.tolist()):
        got[d].append(tuple(x))
    assert got == [brute(t, *codec, rule) for t in texts]


def test_sums_and_odd_rows(odd, codec):
    enc, _ = codec
    rows = op.sections(odd, op.VOCABULARY).collect()
    want = sum(len(enc.encode_ordinary(r.text)) for r in odd.collect() if r.text is not None)
    assert sum(r.tokens for r in rows) == want
    assert op.sections(odd.limit(0), op.VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        op.sections(odd, op.VOCABULARY, rule="half")


@pytest.mark.parametrize("rule", op.RULES)
def test_fields_against_a_loop(spark, codec, rule):
    enc, sizes = codec
    rows = [(1, "A title", "Its text\nof lines", 5), (2, None, "é漢字🎉 only text", None), (3, "", "", 0), (None, "x", None, 7), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, field_0 int")
    columns = ["title", "text", "field_0"]
    got = {}
    for r in op.fields(docs, columns, op.VOCABULARY, rule, separator="\n").collect():
        got[r.doc_id, r.field] = (r.char_start, r.char_end, r.tokens)
    want = {}
    for i, *values in rows:
        if all(v is None for v in values):
            continue
        parts = ["" if v is None else str(v) for v in values]
        whole, ends = "\n".join(parts), []
        for k, p in enumerate(parts):
            a = ends[-1][1] if ends else 0
            ends.append((a, a + len(p) + (k < 2)))
        spans = [(len(whole[:a].encode()), len(whole[:b].encode())) for a, b in ends]
        counts, at = [0] * 3, 0
        for t in enc.encode_ordinary(whole):
            shares = [max(0, min(at + sizes[t], b) - max(at, a)) for a, b in spans]
            touched = [k for k, x in enumerate(shares) if x]
            counts[{"first": touched[0], "last": touched[-1], "most": shares.index(max(shares))}[rule]] += 1
            at += sizes[t]
        want |= {(i, c): (a, b, n) for c, (a, b), n in zip(columns, ends, counts)}
    assert got == want
