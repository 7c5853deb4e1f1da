"""Substring deduplication with difference-cover anchors.

A place is repeated if the LENGTH words that begin there stand at another place too, in the
same or another document.  Windows of WINDOW words are hashed only where the word's index
modulo PERIOD is in COVER, a set whose differences are all residues: whatever the distance
of two equal passages of LENGTH = PERIOD + WINDOW - 1 words, some word of them has an index
in COVER on both sides, so they share an anchor there.  Anchors that are alone go; around
the others each document's anchors are extended to all passages of LENGTH words that hold
one, which are compared by 64-bit hashes.  Runs of repeated places are the spans.

All exchanges carry packed columns: a row holds, for one bucket, the sorted and compressed
hashes, documents and positions of very many anchors.  Buckets follow the number of
characters, so memory of a task does not grow with the corpus.  A passage that very many
documents share does not meet in one bucket: what a task or a bucket of documents knows to be
shared sends one place of it, so a hash's bucket has one row from each of them.

Words are those of words.py; spans count words.  Null and empty texts and those shorter
than LENGTH words have no spans.  Rows that repeat doc_id and text are one document (else
each would be a repetition of itself); rows of one doc_id with different texts are
documents of their own.  A null doc_id stays null and sorts first.  An empty table has no
spans; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, strings
from .words import U64, Words, chunks, tokenize, window_hash

PERIOD, COVER, WINDOW = 31, (1, 5, 11, 24, 25, 27), 20
LENGTH = PERIOD + WINDOW - 1
#: Characters of text to a bucket, of about 30 anchors to 1,000 characters; places that a task packs at once.
BUCKET_CHARS, FLUSH = 24_000_000, 2_000_000
NO_ID = -(1 << 63)  # stands for a null doc_id on the way
PACKED = "bucket int, n int, hash binary, doc binary, tag binary, pos binary, first binary, ref binary"
_KINDS = [tuple(x.split()) for x in PACKED.split(", ")]
_NAMES = [x for x, _ in _KINDS]
_ARROW = pa.schema([(x, pa.int32() if k == "int" else pa.binary()) for x, k in _KINDS])
_TYPES = {"hash": U64, "doc": np.int64, "tag": np.int32, "pos": np.int32, "first": np.int64, "ref": np.int32}
_DELTAS = ("doc", "first", "ref")
Columns = dict[str, np.ndarray]
_SALT = 1_000_003


def _zip(name: str, a: np.ndarray) -> bytes:
    raw = np.diff(a, prepend=a.dtype.type(0)) if name in _DELTAS else a
    return a.tobytes() if name == "hash" else pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unzip(name: str, data: bytes, n: int) -> np.ndarray:
    kind = np.dtype(_TYPES[name])
    if name == "hash":
        return np.frombuffer(data, kind)
    raw = np.frombuffer(pa.decompress(data, n * kind.itemsize, "zstd", asbytes=True), kind)
    return np.cumsum(raw, dtype=kind) if name in _DELTAS else raw


def pack(bucket: np.ndarray, c: Columns) -> Iterator[pa.RecordBatch]:
    """A row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    c = {k: v[order] for k, v in c.items()}
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        rows.append([int(bucket[a]), int(b - a), *(_zip(k, c[k][a:b].astype(_TYPES[k])) if k in c else None for k in _NAMES[2:])])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def unpack(rows: list[dict]) -> Columns:
    return {k: np.concatenate([_unzip(k, r[k], r["n"]) for r in rows]) for k in _NAMES[2:] if rows[0][k] is not None}


def document_bucket(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    return (tag.astype(np.int64) + np.mod(doc, _SALT)) % buckets


def _document_bucket(buckets: int) -> Column:
    return F.pmod(F.col("tag").cast("long") + F.pmod(F.col("doc"), F.lit(_SALT)), F.lit(buckets)).cast("int")


def hash_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(40)) % U64(buckets)).astype(np.int64)


def by_bucket(rows: DataFrame, buckets: int, schema: str, work: Callable[[list[dict]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """work over all rows of each bucket; a task has one bucket."""

    def run(batches: Batches) -> Batches:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
        if held:
            yield from work(held)

    return rows.repartitionById(buckets, "bucket").mapInArrow(run, schema)


def distinct(c: Columns) -> tuple[Columns, np.ndarray, np.ndarray]:
    """The places, each once, in the order of hash, doc, tag and pos; where each hash begins, and how many places it has."""
    order = np.lexsort((c["pos"], c["tag"], c["doc"], c["hash"]))
    c = {k: v[order] for k, v in c.items()}
    one = np.concatenate([[True], np.any([c[k][1:] != c[k][:-1] for k in ("hash", "doc", "tag", "pos")], axis=0)])
    c = {k: v[one] for k, v in c.items()}
    lead = np.flatnonzero(np.concatenate([[True], c["hash"][1:] != c["hash"][:-1]]))
    return c, lead, np.diff(np.append(lead, len(c["hash"])))


def some(c: Columns, at: np.ndarray, *names: str) -> Columns:
    return {k: c[k][at] for k in names or c}


def by_place(c: Columns) -> Columns:
    """In the order of documents and positions, in which these columns compress best."""
    return some(c, np.lexsort((c["pos"], c["tag"], c["doc"])))


def anchors(w: Words) -> np.ndarray:
    """Indices of the words at which anchors begin."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    size = np.diff(w.first)
    at = np.arange(len(w.hash)) - w.first[w.doc]
    return np.flatnonzero(cover[at % PERIOD] & (at + WINDOW <= size[w.doc]) & (size[w.doc] >= LENGTH))


def around(w: Words, at: np.ndarray) -> np.ndarray:
    """Indices of the words at which passages of LENGTH words begin that hold one of these anchors."""
    low = np.maximum(at - (PERIOD - 1), w.first[w.doc[at]])
    high = np.minimum(at, w.first[w.doc[at] + 1] - LENGTH)
    edge = np.zeros(len(w.hash) + 1, np.int64)
    some = low <= high
    np.add.at(edge, low[some], 1)
    np.add.at(edge, high[some] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, word_start, word_end, n_places, first_doc_id (least doc_id that has the span's first LENGTH words) of every span."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    n = max(1, -(-chars // BUCKET_CHARS))

    def find_anchors(batches: Batches) -> Batches:
        held: list[Columns] = []
        size = 0
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for begin, piece in chunks(strings(batch)):
                w = tokenize(piece)
                at = anchors(w)
                if len(at):
                    own = begin + w.doc[at]
                    held.append({"hash": window_hash(w.sums(), at, WINDOW), "doc": doc[own], "tag": tag[own], "pos": at - w.first[w.doc[at]]})
                    size += len(at)
            if size >= FLUSH:
                yield from sent({k: np.concatenate([c[k] for c in held]) for k in held[0]})
                held, size = [], 0
        if held:
            yield from sent({k: np.concatenate([c[k] for c in held]) for k in held[0]})

    def sent(c: Columns) -> Iterator[pa.RecordBatch]:
        # the first place of each hash goes to the hash's bucket; where a hash has more, all are known to be shared, and go to their documents' buckets
        c, lead, count = distinct(c)
        alone = by_place(some(c, lead))
        yield from pack(hash_bucket(alone["hash"], n), alone)
        known = by_place(some(c, np.repeat(count > 1, count), "doc", "tag", "pos"))
        yield from pack(document_bucket(known["doc"], known["tag"], n), known)

    def through(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def shared(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield from through([r for r in rows if r["hash"] is None])
        if rows := [r for r in rows if r["hash"] is not None]:
            c, _, count = distinct(unpack(rows))
            own = by_place(some(c, np.repeat(count > 1, count), "doc", "tag", "pos"))
            yield from pack(document_bucket(own["doc"], own["tag"], n), own)

    def extend(batches: Batches) -> Batches:
        """Windows of one bucket: its places come first, its texts behind them."""
        places: list[dict] = []
        where: dict[tuple[int, int], tuple[int, int]] | None = None
        pos = np.zeros(0, np.int64)
        held: list[Columns] = []
        for batch in batches:
            is_text = np.asarray(batch.column("text").is_valid())
            places += batch.filter(pa.array(~is_text)).select(_NAMES).to_pylist()
            batch = batch.filter(pa.array(is_text))
            if not batch.num_rows:
                continue
            if where is None:
                where = {}
                if places:
                    c, _, _ = distinct({"hash": np.zeros(sum(r["n"] for r in places), U64), **unpack(places)})
                    pos, places = c["pos"], []
                    lead = np.flatnonzero(np.concatenate([[True], (c["doc"][1:] != c["doc"][:-1]) | (c["tag"][1:] != c["tag"][:-1])]))
                    where = {(int(c["doc"][a]), int(c["tag"][a])): (a, b) for a, b in zip(lead, [*lead[1:], len(pos)])}
            rows, texts, ranges = [], [], []
            for key, text in zip(zip(batch.column("doc_of").to_pylist(), batch.column("tag_of").to_pylist()), strings(batch)):
                if (r := where.pop(key, None)) is not None:
                    rows.append(key)
                    texts.append(text)
                    ranges.append(r)
            for begin, piece in chunks(texts):
                w = tokenize(piece)
                at = np.concatenate([pos[a:b] + w.first[k] for k, (a, b) in enumerate(ranges[begin : begin + len(piece)])])
                at = around(w, at)
                key = np.array(rows[begin : begin + len(piece)], np.int64)[w.doc[at]].reshape(-1, 2)
                held.append({"hash": window_hash(w.sums(), at, LENGTH), "doc": key[:, 0], "tag": key[:, 1], "pos": at - w.first[w.doc[at]]})
        if held:
            # as with anchors one place of each hash, with its number in the bucket, stands for the bucket's; all places wait with this number for the answer
            c, lead, count = distinct({k: np.concatenate([x[k] for x in held]) for k in held[0]})
            c["ref"] = np.repeat(np.arange(len(lead)), count)
            asked = by_place(some(c, lead) | {"ref": 2 * np.arange(len(lead)) + (count > 1)})
            del asked["pos"]
            yield from pack(hash_bucket(asked["hash"], n), asked)
            del c["hash"]
            c = by_place(c)
            yield from pack(document_bucket(c["doc"], c["tag"], n), c)

    def repeated(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield from through([r for r in rows if r["hash"] is None])
        if rows := [r for r in rows if r["hash"] is not None]:
            c = unpack(rows)
            c = some(c, np.argsort(c["hash"], kind="stable"))
            lead = np.flatnonzero(np.concatenate([[True], c["hash"][1:] != c["hash"][:-1]]))
            count = np.diff(np.append(lead, len(c["hash"])))
            twice = np.repeat((count > 1) | (np.maximum.reduceat(c["ref"] & 1, lead) > 0), count)
            to, answer = document_bucket(c["doc"], c["tag"], n)[twice], {"ref": c["ref"][twice] >> 1, "first": np.repeat(np.minimum.reduceat(c["doc"], lead), count)[twice]}
            order = np.argsort(answer["ref"], kind="stable")
            yield from pack(to[order], some(answer, order))

    def joined(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        answers, waiting = [r for r in rows if r["first"] is not None], [r for r in rows if r["first"] is None]
        if not answers:
            return
        a, c = unpack(answers), unpack(waiting)
        known, first = np.zeros(int(c["ref"].max()) + 1, bool), np.zeros(int(c["ref"].max()) + 1, np.int64)
        known[a["ref"]], first[a["ref"]] = True, a["first"]
        c = some(c, known[c["ref"]])
        c["first"] = first[c["ref"]]
        order = np.lexsort((c["pos"], c["tag"], c["doc"]))
        doc, tag, pos, first = (c[k][order] for k in ("doc", "tag", "pos", "first"))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] > pos[:-1] + LENGTH)])
        lead = np.flatnonzero(new)
        last = np.concatenate([lead[1:], [len(pos)]]) - 1
        ids = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
        yield pa.RecordBatch.from_arrays([ids(doc[lead]), *(pa.array(x.astype(np.int64)) for x in (pos[lead], pos[last] + LENGTH, last - lead + 1)), ids(first[lead])], names=["doc_id", "word_start", "word_end", "n_places", "first_doc_id"])

    texts = texts.where(F.length("text") >= LENGTH)
    candidates = by_bucket(texts.mapInArrow(find_anchors, PACKED), n, PACKED, shared)
    placed = texts.select(_document_bucket(n).alias("bucket"), *(F.lit(None).cast(k).alias(c) for c, k in _KINDS[1:]), F.col("doc").alias("doc_of"), F.col("tag").alias("tag_of"), "text")
    both = candidates.withColumns({"doc_of": F.lit(None).cast("long"), "tag_of": F.lit(None).cast("int"), "text": F.lit(None).cast("string")}).unionByName(placed)
    windows = both.repartitionById(n, "bucket").sortWithinPartitions(F.col("text").isNotNull()).mapInArrow(extend, PACKED)
    answers = by_bucket(windows, n, PACKED, repeated)
    return by_bucket(answers, n, "doc_id long, word_start long, word_end long, n_places long, first_doc_id long", joined)


#: spans() by all passages of LENGTH words, in DuckDB.
SPANS_SQL = rf"""
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM doc)),
g2 AS (SELECT *, w || ' ' || lead(w, 1) OVER o AS b FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g4 AS (SELECT *, b || ' ' || lead(b, 2) OVER o AS c FROM g2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g8 AS (SELECT *, c || ' ' || lead(c, 4) OVER o AS d FROM g4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g16 AS (SELECT doc_id, i, b, d || ' ' || lead(d, 8) OVER o AS e FROM g8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g50 AS (SELECT doc_id, i, md5(e || ' ' || lead(e, 16) OVER o || ' ' || lead(e, 32) OVER o || ' ' || lead(b, 48) OVER o) AS h FROM g16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS n FROM g50 WHERE h IS NOT NULL),
edge AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS gap FROM seen WHERE n > 1),
island AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM edge)
SELECT doc_id, min(i)::BIGINT AS word_start, (max(i) + {LENGTH})::BIGINT AS word_end, count(*)::BIGINT AS n_places, arg_min(first, i) AS first_doc_id FROM island GROUP BY doc_id, k
"""
