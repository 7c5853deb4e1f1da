"""Quality rules of repetition coverage.

Word n-grams are hashed by differences of prefix sums, for every length in one pass over
a text's word hashes.  A word is covered at length n if it lies in an n-gram that the text
has at least twice; coverage is the characters of covered words among those of all words,
so overlaps count once.  For short lengths the measure is that of the one n-gram with the
most characters over its occurrences (at most 1).  Lines, without blanks at their ends,
count by the characters of those that the text has at least twice, among all lines'.

A repeated (n+1)-gram begins with a repeated n-gram, so each length only looks at what
repeated at the length before.

Null, empty and wordless texts have all measures 0 and are kept.  Rows that repeat are
each judged; a null doc_id stays null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, over, strings
from .words import U64, Words, chunks, mix, tokenize, window_hash

#: Percent that a document may have at most: of one n-gram's occurrences, of repeated n-grams, of repeated lines.
TOP = {2: 20, 3: 18, 4: 16}
REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES = 20
COLUMNS = [*(f"top_{n}" for n in TOP), *(f"dup_{n}" for n in REPEATED), "dup_lines"]
LIMITS = [*TOP.values(), *REPEATED.values(), LINES]


def line_characters(text: str) -> tuple[int, int]:
    """Characters of repeated lines, and of all."""
    seen = Counter(x for x in (line.strip(" \t\r") for line in text.split("\n")) if x)
    return sum(len(x) * n for x, n in seen.items() if n > 1), sum(len(x) * n for x, n in seen.items())


def word_characters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words of each text, and texts by COLUMNS without the last: characters covered."""
    size = w.end - w.start
    k = len(size)
    upto = np.concatenate([[0], np.cumsum(size)])
    total = upto[w.first[1:]] - upto[w.first[:-1]]
    out = np.zeros((w.n, len(TOP) + len(REPEATED)), np.int64)
    at = np.arange(k)
    sums = w.sums()
    for j, n in enumerate([*TOP, *REPEATED]):
        at = at[at + n <= k]
        at = at[w.doc[at] == w.doc[at + n - 1]]
        if not len(at):
            break
        key = window_hash(sums, at, n) ^ mix(w.doc[at].astype(U64))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        count = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        many = np.repeat(count > 1, count)
        if n in TOP:
            lead = at[order[np.flatnonzero(new)[count > 1]]]
            np.maximum.at(out[:, j], w.doc[lead], (upto[lead + n] - upto[lead]) * count[count > 1])
        at = np.sort(at[order[many]])
        if n in REPEATED:
            edge = np.zeros(k + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            inside = np.concatenate([[0], np.cumsum(np.where(np.cumsum(edge[:-1]) > 0, size, 0))])
            out[:, j] = inside[w.first[1:]] - inside[w.first[:-1]]
    return total, np.minimum(out, total[:, None])


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts by COLUMNS: characters, and out of how many."""
    total, covered = word_characters(tokenize(texts))
    lines = np.array([line_characters(t) for t in texts], np.int64)
    return np.column_stack([covered, lines[:, 0]]), np.column_stack([np.repeat(total[:, None], covered.shape[1], axis=1), lines[:, 1]])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the measures in COLUMNS and keep (none above its limit) of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, piece in chunks(strings(batch)):
            part, whole = measured(piece)
            keep = (part * 100 <= whole * np.array(LIMITS)).all(axis=1)
            share = np.round(part / np.maximum(whole, 1), 6)
            columns = [batch.column("doc_id").slice(at, len(piece)), *(pa.array(share[:, j]) for j in range(share.shape[1])), pa.array(keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COLUMNS, "keep"])

    return over(ids_and_texts(docs), f"doc_id long, {', '.join(f'{c} double' for c in COLUMNS)}, keep boolean", run)


def keep_varied(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, without those that a rule rejects."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = [(p * 100 <= t * np.array(LIMITS)).all(axis=1) for _, piece in chunks(strings(batch)) for p, t in [measured(piece)]]
        yield batch.filter(pa.array(np.concatenate(keep)))

    return over(docs, docs.schema, run)


def _sql() -> str:
    lengths = [*TOP, *REPEATED]
    grams = ", ".join(" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))]) + f" AS g{n}" for n in lengths)
    counts = ", ".join(f"CASE WHEN g{n} IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY doc_id, g{n}) END AS c{n}" for n in REPEATED)
    covered = ", ".join(f"max(c{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) > 1 AS in{n}" for n in REPEATED)
    dup = ", ".join(f"coalesce(sum(len(w)) FILTER (in{n}), 0) AS dup_{n}" for n in REPEATED)
    top = ", ".join(f"top{n} AS (SELECT doc_id, max(c) AS top_{n} FROM (SELECT doc_id, count(*) * (len(g{n}) - {n - 1}) AS c FROM gram WHERE g{n} IS NOT NULL GROUP BY doc_id, g{n} HAVING count(*) > 1) GROUP BY doc_id)" for n in TOP)
    parts = [f"top_{n}" for n in TOP] + [f"dup_{n}" for n in REPEATED]
    limits = dict(zip(COLUMNS, LIMITS))
    joins = " ".join(f"LEFT JOIN top{n} USING (doc_id)" for n in TOP)
    chars = ", ".join(f"least(coalesce({p}, 0), all_words) AS {p}" for p in parts)
    shares = ", ".join(f"round(({p} / greatest(all_words, 1))::DOUBLE, 6) AS {p}" for p in parts)
    keep = " AND ".join(f"{p} * 100 <= all_words * {limits[p]}" for p in parts)
    return rf"""
WITH doc AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM documents),
size AS (SELECT doc_id, len(array_to_string(ws, '')) AS all_words FROM doc),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM doc),
gram AS (SELECT doc_id, i, w, {grams} FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, w, {counts} FROM gram),
cover AS (SELECT doc_id, w, {covered} FROM seen),
dup AS (SELECT doc_id, {dup} FROM cover GROUP BY doc_id),
{top},
line AS (SELECT doc_id, x, len(x) * count(*) AS c, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS x FROM doc) WHERE x <> '' GROUP BY doc_id, x),
lines AS (SELECT doc_id, coalesce(sum(c) FILTER (n > 1), 0) AS part, sum(c) AS whole FROM line GROUP BY doc_id),
found AS (SELECT doc_id, all_words, coalesce(part, 0) AS part, coalesce(whole, 0) AS whole, {chars} FROM size LEFT JOIN lines USING (doc_id) LEFT JOIN dup USING (doc_id) {joins})
SELECT doc_id, {shares}, round((part / greatest(whole, 1))::DOUBLE, 6) AS dup_lines, {keep} AND part * 100 <= whole * {LINES} AS keep FROM found
"""


#: measures() in DuckDB, where doc_id is unique.
MEASURES_SQL = _sql()
