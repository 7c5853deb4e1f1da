"""SimHash near-dedup with BK-trees.

A text's fingerprint has 256 bits: the signs of random projections of its set of
words, hashed with signs into 4096 dimensions.  Fingerprints that agree in the bits of
a band fall into one shard; each shard has a BK-tree, in which every member is looked
up, following only edges within the radius.  Links of all shards become connected
components.  A pair that agrees in no band is found by the exact search that follows: of 256
bits in parts, a pair within the radius differs in few enough bits of some part, and all
fingerprints that differ so there and are of different components are compared (plan_parts).  So no link within the
radius is missed; bands only make large families one component before.  Of each component
the row with the least doc_id stays.

The trees are not broadcast: together they grow with the corpus, while each query needs
only the trees of its own shards, so trees and queries meet in one shuffle.  Only a
reference set of bounded size is searched by broadcast trees (search_reference).

Bits per band follow the logarithm of the number of fingerprints, so that a shard has about
SHARD unrelated ones at every size, and the number of bands follows from them, so that a pair at the very rim of the radius is
missed by bands with the chance MISS, and a closer one with less.  Exchanges carry packed columns:
32 bytes of fingerprint and 4 of key for each band, and in the exact search 40 for each block.
The work of the exact search grows with the square of the fingerprints, by a small factor.

Texts that are null or have no words are never linked.  Nulls as doc_id come after all
numbers when the row that stays is chosen.  Rows that repeat doc_id and text are copies
of each other; where they differ in other columns the first by all columns stays.  Ties of
equal doc_id are decided by a hash of the text.  An empty table gives an empty result; other
columns are handed on and cannot clash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bktree
from .common import Batches, bounded, checkpoint, ids_and_texts, over, strings
from .words import U64, chunks, mix, tokenize

BITS, DIMS, RADIUS, SEED = 256, 4096, 40, 7
#: Unrelated fingerprints that meet in a shard: with more of them bands are shorter and fewer, so less is exchanged and more compared in trees.
SHARD, LEAST_BITS, MISS = 64, 8, 0.1
#: Entries (one of a fingerprint in a band) that a task packs at once, their size, and bytes of a bucket.
ENTRIES, ENTRY_BYTES, BUCKET_BYTES = 500_000, 36, 8 << 20
#: Fingerprints of a block of which two are compared in a task (40 bytes each), most bits of a part that are looked up and most of them that may differ, probes that cost
#: as much as a comparison, inverted, and members of a place from which those of one component are passed over.
BLOCK, MOST_BITS, MOST_REACH, PROBE, FULL = 400_000, 20, 3, 0.5, 64
FP = [f"fp{k}" for k in range(BITS // 64)]
#: Fingerprints of a reference set whose trees may be broadcast (40 bytes each).
REFERENCE_ROWS = 500_000


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (DIMS, BITS))


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 64-bit words, and whether the text has words."""
    out, some = np.zeros((len(texts), BITS // 64), U64), np.zeros(len(texts), bool)
    for at, piece in chunks(texts, most_texts=256):
        w = tokenize(piece)
        key = np.unique((w.doc.astype(U64) << U64(54)) | (w.hash >> U64(10)))
        doc = (key >> U64(54)).astype(np.int64)
        place = doc * DIMS + ((key >> U64(20)) % U64(DIMS)).astype(np.int64)
        sign = ((key >> U64(40)) & U64(1)).astype(np.float32) * 2 - 1
        sums = np.bincount(place, weights=sign, minlength=len(piece) * DIMS).reshape(len(piece), DIMS).astype(np.float32)
        out[at : at + len(piece)] = np.packbits(sums @ _projection() > 0, axis=1).view(U64)
        some[at : at + len(piece)] = np.diff(w.first) > 0
    return out, some


def plan_bands(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Bits of a band and number of bands for so many fingerprints: a pair that differs in radius bits agrees in a band with the chance of a draw without replacement."""
    bits = max(LEAST_BITS, round(math.log2(max(n, 1) / SHARD)) if n else 0)
    if radius >= BITS - bits:
        raise ValueError(f"bands of {bits} bits can't find pairs at a radius of {radius}")
    agree = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _positions(bits: int, bands: int) -> np.ndarray:
    """For each band the bits it takes: as far as they go, no bit twice before every bit was taken."""
    rng = np.random.default_rng(SEED + 1)
    stream = np.concatenate([rng.permutation(BITS) for _ in range(math.ceil(bits * bands / BITS))])
    return stream[: bits * bands].reshape(bands, bits)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp0.. and node (hash of the fingerprint) of the texts with words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp, some = fingerprints(strings(batch))
        columns = [batch.column("doc_id"), batch.column("h"), *(pa.array(fp[:, k].view(np.int64)) for k in range(len(FP))), pa.array(node_of(fp))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", *FP, "node"]).filter(pa.array(some))

    texts = ids_and_texts(docs).where("text is not null").withColumn("h", F.xxhash64("text"))
    return over(texts, "doc_id long, h long, " + ", ".join(f"{c} long" for c in FP) + ", node long", run)


def node_of(fp: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint."""
    h = np.zeros(len(fp), U64)
    for k in range(fp.shape[1]):
        h = mix(h ^ fp[:, k])
    return h.view(np.int64)


def band_keys(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows by bands: hash of the band and of the bits that the fingerprint has there."""
    on = np.unpackbits(fp.view(np.uint8), axis=1).astype(np.float64)
    scale = 2.0 ** np.arange(min(at.shape[1], 50))
    own = np.stack([(on[:, p[: len(scale)]] @ scale).astype(U64) for p in at], axis=1)
    return mix(own * U64(0x9E3779B97F4A7C15) + np.arange(1, len(at) + 1, dtype=U64))


def _banded(nodes: DataFrame, bits: int, bands: int, buckets: int) -> DataFrame:
    """Packed shards: rows of a bucket, the tags (32 bits of the key) and fingerprints of very many entries."""
    at = _positions(bits, bands)
    own = max(64, ENTRIES // bands)

    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy() for c in FP], axis=1).view(U64))
            while sum(map(len, held)) >= own:
                whole = np.concatenate(held)
                held = [whole[own:]]
                yield packed(whole[:own])
        if sum(map(len, held)):
            yield packed(np.concatenate(held))

    def packed(fp: np.ndarray) -> pa.RecordBatch:
        fp = np.ascontiguousarray(fp)
        keys = np.concatenate([band_keys(fp[a : a + 512], at) for a in range(0, len(fp), 512)]).ravel()
        bucket = (keys >> U64(32)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, tags, rows = bucket[order], keys[order].astype(np.uint32), order // bands
        lead = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        parts = list(zip(lead, [*lead[1:], len(bucket)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[lead].astype(np.int32)), pa.array([tags[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([fp[rows[a:b]].tobytes() for a, b in parts], pa.binary())], names=["bucket", "tags", "fps"]
        )

    return nodes.select(*FP).mapInArrow(run, "bucket int, tags binary, fps binary")


def _links(banded: DataFrame, radius: int, buckets: int) -> DataFrame:
    """node, root: links within the shards, as stars. A task holds one bucket after the other."""

    def linked(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        tags = np.concatenate([np.frombuffer(t, np.uint32) for t, _ in rows])
        order = np.argsort(tags, kind="stable")
        tags = tags[order]
        same = tags[1:] == tags[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # shards of one have no links
        fps = np.concatenate([np.frombuffer(f, U64) for _, f in rows]).reshape(-1, len(FP))[order[many]]
        group = np.cumsum(np.concatenate([[0], tags[many][1:] != tags[many][:-1]]))
        label = bktree.components(bktree.build(fps, group), radius) if len(fps) else np.zeros(0, np.int64)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node_of(fps[moved])), pa.array(node_of(fps[label[moved]]))], names=["node", "root"])

    def run(batches: Batches) -> Batches:
        held: list[tuple[bytes, bytes]] = []
        last = None
        for batch in batches:
            for bucket, tags, fps in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tags", "fps"))):
                if held and bucket != last:
                    yield linked(held)
                    held = []
                held.append((tags, fps))
                last = bucket
        if held:
            yield linked(held)

    return banded.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, root long").distinct()


def plan_parts(n: int, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the bits it takes and the masks that two fingerprints may differ by there. No bit is in two parts, and the reach of the
    parts and one for each of them add up to radius + 1, so a pair that is farther apart in every part is out of the radius: none is missed.
    The number of parts is the one of the least work, by calculation, for n fingerprints of independent bits."""

    def work(parts: list[tuple[int, int]]) -> float:
        return sum(sum(math.comb(w, k) for k in range(reach + 1)) * (PROBE * min(n, 1 << w) + n * n / (1 << w)) for w, reach in parts)

    plans = []
    for t in range(1, min(radius + 1, BITS) + 1):
        plan = [(min(MOST_BITS, BITS // t + (k < BITS % t)), (radius + 1) // t - 1 + (k < (radius + 1) % t)) for k in range(t)]
        if plan[0][1] <= MOST_REACH or t == radius + 1:
            plans.append(plan)
    plan = min(plans, key=work)
    bits = np.array_split(np.random.default_rng(SEED + 2).permutation(BITS), len(plan))
    return [(own[:w], np.array([sum(1 << b for b in c) for k in range(reach + 1) for c in itertools.combinations(range(w), k)], np.int32)) for own, (w, reach) in zip(bits, plan)]


def across(fps: np.ndarray, label: np.ndarray, other: np.ndarray | None, other_label: np.ndarray | None, parts: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """Rows of two labels, the lesser first: all pairs of labels that a pair of fingerprints within the radius links, by the given parts of plan_parts.
    Pairs are of a fingerprint and one of the others, or where other is None of two of the same."""
    names, rank = np.unique(label if other is None else np.concatenate([label, other_label]), return_inverse=True)
    sides = [(fps, rank[: len(fps)]), (fps, rank) if other is None else (other, rank[len(fps) :])]
    weights = np.zeros((BITS, len(parts)), np.float32)
    for k, (bits, _) in enumerate(parts):
        weights[bits, k] = 2.0 ** np.arange(len(bits))
    values = [np.concatenate([np.unpackbits(np.ascontiguousarray(f[a : a + 4096]).view(np.uint8), axis=1) @ weights for a in range(0, len(f), 4096)]).astype(np.int64) if len(f) else np.zeros((0, len(parts)), np.int64) for f, _ in sides]
    found = [np.zeros(0, np.int64)]
    for k, (bits, masks) in enumerate(parts):
        (key, order), (other_key, other_order) = ((key := v[:, k] << 32 | r, order := np.argsort(key, kind="stable")) and (key[order], order) for v, (_, r) in zip(values, sides))
        left, right = ([np.ascontiguousarray(f[o, w]) for w in range(f.shape[1])] for (f, _), o in zip(sides, (order, other_order)))
        first = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        value, size = (key[first] >> 32).astype(np.int32), np.diff(first, append=len(key))
        start = np.searchsorted(other_key >> 32, np.arange((1 << len(bits)) + 1))
        taken = start[1:] > start[:-1]
        step = max(1, bktree.PAIRS // max(1, len(key)))
        for some in (masks[a : a + step, None] for a in range(0, len(masks), step)):
            to = value ^ some
            met = taken[to]
            if other is None:
                met &= value <= to
            met = np.flatnonzero(met)
            at, to = met % max(1, len(value)), to.ravel()[met].astype(np.int64)
            rows = _ranges(first[at], size[at])
            to = np.repeat(to, size[at])
            lo, hi = start[to], start[to + 1]
            if len(full := np.flatnonzero(hi - lo > FULL)):  # those of one label are passed over at once, however many they are
                own = to[full] << 32 | (key[rows[full]] & 0xFFFFFFFF)
                rows = np.concatenate([rows, rows[full]])
                lo, hi = np.concatenate([lo, np.searchsorted(other_key, own, side="right")]), np.concatenate([hi, hi[full]])
                hi[full] = np.searchsorted(other_key, own)
            work = np.cumsum(hi - lo)
            for block in np.split(np.arange(len(rows)), np.searchsorted(work, np.arange(bktree.PAIRS, work[-1] if len(work) else 0, bktree.PAIRS))):
                i, j = np.repeat(rows[block], hi[block] - lo[block]), _ranges(lo[block], hi[block] - lo[block])
                for w in (slice(0, 2), slice(0, None)):  # half of the words tell nearly all that are far
                    near = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int16) for x, y in zip(left[w], right[w])) <= radius
                    i, j = i[near], j[near]
                a, b = key[i] & 0xFFFFFFFF, other_key[j] & 0xFFFFFFFF
                found.append(np.unique((np.minimum(a, b) << 32 | np.maximum(a, b))[a != b]))
    pair = np.unique(np.concatenate(found))
    return np.stack([names[pair >> 32], names[pair & 0xFFFFFFFF]], axis=1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _rest(labelled: DataFrame, n: int, radius: int) -> DataFrame:
    """node, root: the links between different components that the bands left out, all of them. The fingerprints are split into blocks by their
    hash; a task compares two blocks in some of the parts, so that no task holds more than two blocks, and few blocks are work for all cores."""
    blocks = max(1, -(-n // BLOCK))
    parts = plan_parts(-(-max(1, n) // blocks), radius)
    pairs = blocks * (blocks + 1) // 2
    own = -(-len(parts) // max(1, 2 * labelled.sparkSession.sparkContext.defaultParallelism // pairs))
    splits = -(-len(parts) // own)

    def packed(batches: Batches) -> Batches:
        for batch in batches:
            fp = np.stack([batch.column(c).to_numpy() for c in FP], axis=1) if batch.num_rows else np.zeros((0, len(FP)), np.int64)
            label, block = batch.column("component").to_numpy(), batch.column("node").to_numpy().view(U64) % U64(blocks)
            for b in np.unique(block).tolist():
                held = fp[block == b].tobytes(), label[block == b].tobytes()
                tasks = [(max(b, c) * (max(b, c) + 1) // 2 + min(b, c)) * splits + k for c in range(blocks) for k in range(splits)]
                columns = [pa.array(tasks, pa.int32()), pa.array([b] * len(tasks), pa.int32()), *(pa.array([h] * len(tasks), pa.binary()) for h in held)]
                yield pa.RecordBatch.from_arrays(columns, names=["task", "block", "fps", "labels"])

    def compared(batches: Batches) -> Batches:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        last = None
        for batch in batches:
            for task, block, fps, labels in zip(*(batch.column(c).to_pylist() for c in ("task", "block", "fps", "labels"))):
                if held and task != last:
                    yield linked(last, held)
                    held = {}
                held.setdefault(block, []).append((fps, labels))
                last = task
        if held:
            yield linked(last, held)

    def linked(task: int, held: dict[int, list[tuple[bytes, bytes]]]) -> pa.RecordBatch:
        k, pair = task % splits, task // splits
        sides = [(np.frombuffer(b"".join(f for f, _ in rows), U64).reshape(-1, len(FP)), np.frombuffer(b"".join(x for _, x in rows), np.int64)) for rows in held.values()]
        within = math.isqrt(8 * pair + 9) ** 2 == 8 * pair + 9  # the pair of a block and itself is the last of its row in the triangle
        out = np.zeros((0, 2), np.int64)
        if within or len(sides) == 2:
            out = across(*sides[0], *(sides[1] if len(sides) == 2 else (None, None)), parts[k * own : (k + 1) * own], radius)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 1]), pa.array(out[:, 0])], names=["node", "root"])

    rows = labelled.select("node", "component", *FP).mapInArrow(packed, "task int, block int, fps binary, labels binary")
    return rows.repartitionById(pairs * splits, "task").sortWithinPartitions("task").mapInArrow(compared, "node long, root long").distinct()


def connected(edges: DataFrame, a: str = "node", b: str = "root") -> DataFrame:
    """node, component (its least node) of every node that has a link: alternating large and small stars until nothing changes."""
    e = checkpoint(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        # least neighbours are aggregated before the exchange, so a hub's many edges meet its one row in a join, which splits where it is skewed
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).unionByName(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def members(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, h, rows (of the table), component, keeper, keeper_h, size of each (doc_id, text) that is in a group of two rows or more."""
    sig = checkpoint(signatures(docs))
    nodes = checkpoint(sig.groupBy("node").agg(*(F.min(c).alias(c) for c in FP)))
    n = nodes.count()
    bits, bands = plan_bands(n, radius)
    buckets = max(1, -(-n * bands * ENTRY_BYTES // BUCKET_BYTES))
    parts = connected(_links(_banded(nodes, bits, bands, buckets), radius, buckets))
    rest = checkpoint(_rest(nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), n, radius))
    records = sig.groupBy("doc_id", "h", "node").agg(F.count("*").alias("rows"))
    grouped = records.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if links := rest.count():
        whole = connected(rest).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        grouped = grouped.join(bounded(whole, 2 * links), "component", "left").withColumn("component", F.coalesce("whole", "component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    best = grouped.groupBy("component").agg(F.min(order).alias("first"), F.sum("rows").alias("size")).where("size > 1")
    return grouped.join(best, "component").select("doc_id", "h", "rows", "component", F.col("first.doc_id").alias("keeper"), F.col("first.h").alias("keeper_h"), "size")


def removed(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, duplicate_of, group_size, n_rows: what deduplication takes away, as so many rows of doc_id; of a row that repeats the one that stays, doc_id is duplicate_of."""
    stays = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("h") == F.col("keeper_h"))
    m = members(docs, radius).withColumn("n_rows", F.col("rows") - F.when(stays, 1).otherwise(0)).where("n_rows > 0")
    return m.select("doc_id", F.col("keeper").alias("duplicate_of"), F.col("size").alias("group_size"), "n_rows", "h", stays.alias("stays"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns as they are, with one row of each group."""
    gone = checkpoint(removed(docs, radius).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("stays").alias("__stays")))
    rows = gone.count()
    match = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__h"))
    kept = docs.join(bounded(gone, rows), match, "left_anti")
    again = gone.where("__stays")
    if again.isEmpty():
        return kept
    # of the rows that repeat the one that stays the first by all columns; aggregated before the exchange, however many they are
    row, by = F.struct(*docs.columns), F.struct(F.to_json(F.struct(*docs.columns)))
    repeated = docs.join(bounded(again, rows), match, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__h")).agg(F.min_by(row, by).alias("__row"))
    return kept.unionByName(repeated.select("__row.*"))


def search_reference(docs: DataFrame, reference: DataFrame, radius: int = RADIUS, most: int = REFERENCE_ROWS, shards: int = 8) -> DataFrame:
    """doc_id, reference_id, distance of all pairs within the radius. The reference set's trees, one per shard, are broadcast; a larger set than most is an error."""
    rows = signatures(reference).select("doc_id", *FP).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a reference set of more than {most} fingerprints can't be broadcast; deduplicate the union instead")
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, *r[1:]))
    group = np.arange(len(rows)) * shards // max(1, len(rows))
    fps = np.array([r[1:] for r in rows], np.int64).reshape(len(rows), len(FP)).view(U64)
    held = docs.sparkSession.sparkContext.broadcast((bktree.build(fps, group), [r.doc_id for r in rows]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        forest, ids = held.value
        queries = np.stack([batch.column(c).to_numpy() for c in FP], axis=1).view(U64)
        for root in np.unique(forest.root):
            for a in range(0, len(queries), 256):
                q, item, d = bktree.search(forest, queries[a : a + 256], np.full(len(queries[a : a + 256]), root), radius)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(q + a)), pa.array([ids[i] for i in item], pa.int64()), pa.array(d)], names=["doc_id", "reference_id", "distance"])

    return over(signatures(docs).select("doc_id", *FP), "doc_id long, reference_id long, distance long", run)
