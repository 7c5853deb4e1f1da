"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

Every window of n words of every text is looked up by a 64-bit hash in the set;
hits are verified word by word.  Overlapping or touching hits of one item are a span.
Spans are cut out of a text; a text of whose words at least DROP_SHARE are in spans is
removed as a whole.

Items of fewer than n words are one window of all their words, if these are at least
LEAST; still shorter ones, null and empty ones are not looked for.  Null and empty texts
have no spans and stay.  Rows that repeat are each judged.  A benchmark of more than
SET_CHARS characters is looked up in several scans of the whole texts, each with a set of
that size; the spans of all of them are judged and cut together.  Empty tables have no spans
and stay as they are; other columns are handed on and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_texts, over, replaced, strings
from .words import U64, Words, chunks, tokenize, words_of

N, LEAST, DROP_SHARE = 8, 5, 0.5
#: Characters of benchmark whose n-grams are broadcast at once (about 3 bytes of memory each).
SET_CHARS = 20_000_000


@dataclass
class Grams:
    """Different windows of one length: sorted hashes, the item and first word of an example of each, and the items that have it."""

    n: int
    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    begin: np.ndarray  # of each window's items in owners; one more at the end
    owners: np.ndarray
    maybe: np.ndarray  # by the upper 20 bits of a hash, whether there is one like it


@dataclass
class Index:
    ids: list[int | None]
    words: list[list[str]]
    grams: list[Grams]


def build(items: list[tuple[int | None, str]], n: int = N, least: int = LEAST) -> Index:
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, (_, text) in enumerate(items):
        w = tokenize([text])
        size = min(n, len(w.hash))
        if size >= min(least, n):
            at, h = w.windows(size)
            found.setdefault(size, []).append((h, np.full(len(at), i), at))
    words = [words_of(t) for _, t in items]
    grams = []
    for size, parts in sorted(found.items()):
        h, item, at = map(np.concatenate, zip(*parts))
        order = np.lexsort((at, item, h))
        h, item, at = h[order], item[order], at[order]
        # equal windows are compared with a text once, however many items have them; different ones of one hash stay apart
        kind = np.zeros(len(h), np.int64)
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        for a, b in zip(lead, [*lead[1:], len(h)]):
            if b > a + 1:
                names: dict[tuple[str, ...], int] = {}
                kind[a:b] = [names.setdefault(tuple(words[i][p : p + size]), len(names)) for i, p in zip(item[a:b].tolist(), at[a:b].tolist())]
        order = np.lexsort((at, item, kind, h))
        h, item, at, kind = h[order], item[order], at[order], kind[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])])
        once = new | np.concatenate([[True], item[1:] != item[:-1]])
        begin = np.append(np.cumsum(once)[new] - 1, once.sum())
        maybe = np.zeros(1 << 20, bool)
        maybe[h >> U64(44)] = True
        grams.append(Grams(size, h[new], item[new], at[new], begin, item[once], maybe))
    return Index([i for i, _ in items], words, grams)


def indexes(benchmark: DataFrame, n: int, least: int, most: int = SET_CHARS) -> tuple[int, Iterator[Index]]:
    """Number of sets of bounded size, and the sets, collected one after the other."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // most) + 1
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))

    def made() -> Iterator[Index]:
        for k in range(parts):
            rows = (items if parts == 1 else items.where(shard == k)).collect()
            yield build(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), n, least)

    return parts, made()


def hits(index: Index, w: Words, texts: list[str], each: bool = True) -> list[tuple[int, int, int, int]]:
    """(text, item, first word in the text, number of words) of each verified hit; if not each, of one item of those that share a window."""
    out = []
    cache: dict[int, list[str]] = {}
    for g in index.grams:
        at, h = w.windows(g.n)
        some = g.maybe[h >> U64(44)]
        at, h = at[some], h[some]
        lo, hi = np.searchsorted(g.hash, h), np.searchsorted(g.hash, h, side="right")
        for k in np.flatnonzero(hi > lo):
            doc = int(w.doc[at[k]])
            if doc not in cache:
                cache[doc] = words_of(texts[doc])
            p = int(at[k] - w.first[doc])
            own = cache[doc][p : p + g.n]
            for e in range(lo[k], hi[k]):
                i, q = int(g.item[e]), int(g.at[e])
                if index.words[i][q : q + g.n] == own:
                    out += [(doc, x, p, g.n) for x in g.owners[g.begin[e] : g.begin[e + 1]].tolist()] if each else [(doc, 0, p, g.n)]
                    break
    return out


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, word after the last, hits) of each span."""
    spans: list[list[int]] = []
    for doc, item, p, n in sorted(found):
        if spans and spans[-1][:2] == [doc, item] and p <= spans[-1][3]:
            spans[-1][3] = max(spans[-1][3], p + n)
            spans[-1][4] += 1
        else:
            spans.append([doc, item, p, p + n, 1])
    return [tuple(s) for s in spans]


def spans(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, most: int = SET_CHARS) -> DataFrame:
    """doc_id, item_id, word_start, word_end, char_start, char_end, n_hits of every span."""
    schema = "doc_id long, item_id long, word_start long, word_end long, char_start long, char_end long, n_hits long"
    names = [x.split()[0] for x in schema.split(", ")]
    texts = ids_and_texts(docs).where("text is not null")
    found = None
    for index in indexes(benchmark, n, least, most)[1]:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, held=held) -> Iterator[pa.RecordBatch]:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for at, piece in chunks(strings(batch)):
                w = tokenize(piece)
                for doc, item, a, b, k in merged(hits(held.value, w, piece)):
                    f = w.first[doc]
                    rows.append((ids[at + doc], held.value.ids[item], a, b, int(w.start[f + a]), int(w.end[f + b - 1]), k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

        part = over(texts, schema, run)
        found = part if found is None else found.unionByName(part)
    return found


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the character spans, which are in order and do not overlap."""
    ends = [0, *(x for c in cuts for x in c), len(text)]
    return "".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, share: float = DROP_SHARE, most: int = SET_CHARS) -> DataFrame:
    """The documents, with spans cut out of text (n_chars follows, where it is a column) or rows removed; other columns as they are."""
    parts, made = indexes(benchmark, n, least, most)
    schema, column = docs.schema, "spans"
    while column in (x.lower() for x in docs.columns):
        column += "_"
    between = T.StructType([*schema.fields, T.StructField(column, T.ArrayType(T.LongType()))])  # words of the spans that were found: first, behind the last, ...
    for k, index in enumerate(made):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, held=held, first=k == 0, last=k == parts - 1) -> Iterator[pa.RecordBatch]:
            texts, keep = strings(batch), np.ones(batch.num_rows, bool)
            found = [[] for _ in texts] if first else batch.column(batch.num_columns - 1).to_pylist()
            rest = batch if first else batch.select(batch.schema.names[:-1])
            changed = False
            for at, piece in chunks(texts):
                w = tokenize(piece)
                for doc, _, a, b, _ in merged(hits(held.value, w, piece, each=False)):
                    found[at + doc] += [a, b]
                for doc in range(len(piece)) if last else ():
                    ends = found[at + doc]
                    if not ends:
                        continue
                    f, total = w.first[doc], w.first[doc + 1] - w.first[doc]
                    inside = np.zeros(total + 2, bool)
                    for a, b in zip(ends[::2], ends[1::2]):
                        inside[a + 1 : b + 1] = True
                    changed = True
                    if inside.sum() >= share * total:
                        keep[at + doc] = False
                    else:
                        edges = np.flatnonzero(inside[1:] != inside[:-1])  # touching spans, of whatever items, are cut as one
                        texts[at + doc] = without(piece[doc], [(int(w.start[f + a]), int(w.end[f + b - 1])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
            if not last:
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.list_(pa.int64()))], names=[*rest.schema.names, column])
                return
            if changed:
                columns = {"text": pa.array(texts, pa.string())}
                if "n_chars" in rest.schema.names:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                rest = replaced(rest, columns).filter(pa.array(keep))
            yield rest

        docs = over(docs, schema if k == parts - 1 else between, run)
    return docs


#: spans() in DuckDB; the mere number of an item's words tells the length of its windows.
SPANS_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS ws FROM benchmark),
test AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS g
         FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM item WHERE len(ws) >= 5)),
sizes AS (SELECT DISTINCT least(8, len(ws)) AS n FROM item WHERE len(ws) >= 5),
train AS (SELECT doc_id, i - 1 AS p, n, array_to_string(ws[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, p, p + n AS e FROM train JOIN test USING (g)),
edge AS (SELECT *, max(e) OVER (PARTITION BY doc_id, item_id ORDER BY p, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
island AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY p, e ROWS UNBOUNDED PRECEDING) AS k FROM edge),
span AS (SELECT doc_id, item_id, min(p)::BIGINT AS word_start, max(e)::BIGINT AS word_end, count(*)::BIGINT AS n_hits FROM island GROUP BY doc_id, item_id, k),
piece AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS j FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+') AS ps FROM documents WHERE doc_id IN (SELECT doc_id FROM span))),
ends AS (SELECT doc_id, s, j, sum(len(s)) OVER (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM piece),
placed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS w, e - len(s) AS a, e FROM ends WHERE regexp_matches(s, '^[\p{L}\p{N}\p{M}]'))
SELECT span.*, x.a::BIGINT AS char_start, y.e AS char_end FROM span JOIN placed x ON x.doc_id = span.doc_id AND x.w = word_start JOIN placed y ON y.doc_id = span.doc_id AND y.w = word_end - 1
"""
