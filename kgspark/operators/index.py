"""The inverted index: term frequencies, document frequencies, weights, cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Analyzer, batched, tokens_fold
from ..functions.tokens import Found, per_row
from ..shared import parted


#: Terms of more than one node that are sent to the tasks (12 bytes each); beyond, postings and terms are exchanged.
SENT_TERMS = 1 << 24


def repeats(nodes: DataFrame, key: str) -> bool:
    """Whether rows have one key, or none."""
    return not nodes.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


def _mapped(nodes: DataFrame, analyzer: Analyzer, key: str, text: str, schema: str, make: Callable[[Found], dict[str, pa.Array | np.ndarray] | None], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the key (and what is carried) of their text that make() gives (row, and the columns of the schema), of all texts slice by slice where
    they are: no exchange."""
    before, words = batched(analyzer)
    own = (key, *carry)
    kept = nodes.select(before(F.col(text)).alias("low"), *own)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in words.batches(batch.column(0)):
                made = make(found)
                if made is not None and len(made["row"]):
                    at = pa.array(made["row"] + first)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own), *(pa.array(made[c]) for c in names)], names=[*own, *names])

    return kept.mapInArrow(run, T.StructType([*(T.StructField(c, kept.schema[c].dataType) for c in own), *T._parse_datatype_string(schema).fields]))


def _tf(found: Found) -> np.ndarray:
    runs, of = per_row(found.row)
    return found.freq / np.maximum.reduceat(found.freq, runs)[of]


def postings(nodes: DataFrame, analyzer: Analyzer = tokens_fold, key: str = "node_id", text: str = "content") -> DataFrame:
    """key, term, freq, term_idx (rank of the first occurrence among the node's terms) and tf (frequency by the node's largest).

    Nodes without terms have no rows. Texts are counted where they are; only where a key has several texts, or the analyzer is one's own, there is an
    exchange of the nodes, by key, whose partitioning stays."""
    if batched(analyzer) and not repeats(nodes, key):
        make = lambda f: {"row": f.row, "term": f.terms(), "freq": f.freq, "term_idx": f.rank.astype(np.int32), "tf": _tf(f)} if len(f.row) else None
        return _mapped(nodes, analyzer, key, text, "term string, freq bigint, term_idx int, tf double", make)
    placed = parted(nodes.select(key, text), key)
    words = placed.select(key, F.posexplode(analyzer(F.col(text))).alias("pos", "term"))
    own = words.groupBy(key, "term").agg(F.count("*").alias("freq"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key)
    return own.select(key, "term", "freq", (F.row_number().over(w.orderBy("pos")) - 1).alias("term_idx"), (F.col("freq") / F.max("freq").over(w)).alias("tf"))


def counted(nodes: DataFrame, analyzer: Analyzer, key: str = "node_id", text: str = "content") -> DataFrame:
    """key, term, n: how often each node has each term."""
    if batched(analyzer) and not repeats(nodes, key):
        return _mapped(nodes, analyzer, key, text, "term string, n bigint", lambda f: {"row": f.row, "term": f.terms(), "n": f.freq})
    # the one exchange is of texts by key, before they are words; counting keeps it
    return parted(nodes.select(key, text), key).select(key, F.explode(analyzer(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def frequencies(nodes: DataFrame, analyzer: Analyzer = tokens_fold, key: str = "node_id", text: str = "content") -> DataFrame:
    """term, df: in how many nodes each term is. What is exchanged are the different terms of each slice of texts, not the postings."""
    if not batched(analyzer) or repeats(nodes, key):
        return postings(nodes, analyzer, key, text).groupBy("term").agg(F.count("*").alias("df"))
    before, words = batched(analyzer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.RecordBatch:
            return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"]).combine_chunks()

        for batch in batches:
            for _, found in words.batches(batch.column(0)):
                _, first, n = np.unique(found.word, return_index=True, return_counts=True)
                order = np.argsort(first)
                held.append(pa.table({"term": found.terms(first[order]), "df": n[order]}))
                rows += len(n)
                if rows > 1_000_000:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > 500_000:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed().to_batches()

    return nodes.select(before(F.col(text)).alias("low")).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass(frozen=True)
class Sent:
    """The terms of more than one node, in tasks: by ascending hash their number of nodes, and their place when ordered by it, the most frequent first."""

    of: object  # a broadcast of the three arrays
    n: int

    def looked_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """df (1 for all others), idf and place (-1 for all others) of hashes."""
        known, df, place = self.of.value
        if not len(known):
            at, same = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
            df, place = np.ones(1, np.int64), np.zeros(1, np.int64)
        else:
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            same = known[at] == word
        df = np.where(same, df[at], 1).astype(np.int64)
        return df, self.idf(df), np.where(same, place[at], -1).astype(np.int64)

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log((self.n + 1) / (df + 1)) + 1


def sent(inverse: DataFrame, n: int, analyzer: Analyzer = tokens_fold) -> Sent | None:
    """The terms for the tasks; None if there are too many, or the analyzer is one's own."""
    if not batched(analyzer):
        return None
    shared = inverse.where("df > 1").select("term", "df")
    if shared.count() > SENT_TERMS:
        return None
    _, words = batched(analyzer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes(batch.column(0).to_pylist()).view(np.int64)), batch.column(1).cast(pa.int32())], names=["word", "df"])

    got = shared.mapInArrow(run, "word bigint, df int").toArrow()
    word, df = got["word"].to_numpy().view(np.uint64), got["df"].to_numpy()
    order = np.argsort(word)
    word, df = word[order], df[order]
    place = np.empty(len(df), np.int32)
    place[np.lexsort((word, -df))] = np.arange(len(df), dtype=np.int32)
    return Sent(inverse.sparkSession.sparkContext.broadcast((word, df, place)), n)


def weighed(nodes: DataFrame, inverse: DataFrame, n: int, analyzer: Analyzer = tokens_fold, key: str = "node_id", text: str = "content", only: list[str] | None = None, most: int | None = None, below: int | None = None) -> DataFrame:
    """key, term, freq, term_idx, tf, df, idf, weight = tf * idf, norm (of the node) of the postings. Texts are counted again and weights looked up where
    they are, so no posting is exchanged. inverse: term, df, idf of these nodes; n: their number.

    only: of these terms; most: at least the so many heaviest of each node, with those that weigh the same; below: of terms of 2 to below - 1 nodes."""
    table = None if batched(analyzer) and repeats(nodes, key) else sent(inverse, n, analyzer)
    if table is None:
        w = weights(postings(nodes, analyzer, key, text), inverse)
        w = w.join(norms(w, key), key)
        w = w if only is None else w.where(F.col("term").isin(only))
        return (w if below is None else w.where((F.col("df") > 1) & (F.col("df") < below))).select(key, "term", "freq", "term_idx", "tf", "df", "idf", "weight", "norm")
    asked = None if only is None else batched(analyzer)[1].hashes(only)

    def make(f: Found) -> dict | None:
        if not len(f.row):
            return None
        df, idf, _ = table.looked_up(f.word)
        tf = _tf(f)
        weight = tf * idf
        runs, of = per_row(f.row)
        norm = np.sqrt(np.add.reduceat(weight * weight, runs))[of]
        keep = np.ones(len(df), bool)
        if asked is not None:
            keep &= np.isin(f.word, asked)
        if below is not None:
            keep &= (df > 1) & (df < below)
        if most is not None:
            order = np.lexsort((-weight, of))
            size = np.diff(np.append(runs, len(of)))
            least = weight[order[runs + np.minimum(size, most) - 1]]
            keep &= weight >= (least - 1e-8)[of]  # ties by a rounded weight are settled later
        k = np.flatnonzero(keep)
        return {"row": f.row[k], "term": f.terms(k), "freq": f.freq[k], "term_idx": f.rank[k].astype(np.int32), "tf": tf[k], "df": df[k], "idf": idf[k], "weight": weight[k], "norm": norm[k]}

    return _mapped(nodes, analyzer, key, text, "term string, freq bigint, term_idx int, tf double, df bigint, idf double, weight double, norm double", make)


def indexed(nodes: DataFrame, skip: tuple[str, ...] = ("document",)) -> DataFrame:
    """The nodes that are indexed: all but documents' titles."""
    return nodes.where(~F.col("type").isin(*skip))


def idf(found: DataFrame, n: DataFrame) -> DataFrame:
    """term, df, idf = ln((n + 1) / (df + 1)) + 1. n: one row, one number of nodes."""
    return inverse(found.groupBy("term").agg(F.count("*").alias("df")), n)


#: Bytes of a packed term: four of its place, three of its frequency, each in a plane of its own, so that what is zero compresses.
PLANES = 7


def rare(nodes: DataFrame, table: Sent, below: int | None, analyzer: Analyzer = tokens_fold, key: str = "node_id", text: str = "content") -> DataFrame:
    """key, word (its place in the table), term_idx of the postings of terms of 2 to below - 1 nodes (None: or more)."""

    def make(f: Found) -> dict:
        df, _, place = table.looked_up(f.word)
        k = np.flatnonzero((df > 1) & (df < (below or df.max(initial=0) + 1)))
        return {"row": f.row[k], "word": place[k], "term_idx": f.rank[k].astype(np.int32)}

    return _mapped(nodes, analyzer, key, text, "word bigint, term_idx int", make)


def packed(nodes: DataFrame, table: Sent, analyzer: Analyzer = tokens_fold, key: str = "node_id", text: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, what is carried, norm, top (its largest frequency) and terms of each node with words, the terms of other nodes too only, packed."""

    def make(f: Found) -> dict | None:
        if not len(f.row):
            return None
        df, idf, place = table.looked_up(f.word)
        runs, of = per_row(f.row)
        top = np.maximum.reduceat(f.freq, runs)
        weight = f.freq / top[of] * idf
        norm = np.sqrt(np.add.reduceat(weight * weight, runs))
        k = np.flatnonzero(place >= 0)
        k = k[np.lexsort((place[k], of[k]))]
        n = np.bincount(of[k], minlength=len(runs))
        begin = np.cumsum(n) - n
        own = of[k]
        at = begin[own] * PLANES + np.arange(len(k)) - begin[own]
        gap = place[k].copy()
        gap[1:] -= np.where(own[1:] == own[:-1], place[k][:-1], 0)
        data = np.empty(len(k) * PLANES, np.uint8)
        for p in range(PLANES):
            data[at + p * n[own]] = (gap >> 8 * p if p < 4 else f.freq[k] >> 8 * (p - 4)) & 255
        cuts = np.append(begin, len(k)).astype(np.int32) * PLANES
        return {"row": f.row[runs], "norm": norm, "top": top.astype(np.int32), "terms": pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(cuts), pa.py_buffer(data)])}

    return _mapped(nodes, analyzer, key, text, "norm double, top int, terms binary", make, carry)


def unpacked(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed terms the place where each node's begin (and the end), the terms' places, their frequencies."""
    cuts = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64) if len(terms) else np.zeros(1, np.int64)
    begin = (cuts - cuts[0]) // PLANES
    n = np.diff(begin)
    place, freq = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int32)
    if not len(place):
        return begin, place, freq
    data = np.frombuffer(terms.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    step = max(1, len(terms) * (1 << 20) // len(place))  # nodes at once
    for x in range(0, len(terms), step):
        y = min(x + step, len(terms))
        lo, hi = begin[x], begin[y]
        at = np.arange(lo, hi) + np.repeat(begin[x:y] * (PLANES - 1), n[x:y])
        wide = np.repeat(n[x:y], n[x:y])
        gap, f = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        for p in range(PLANES):
            if p < 4:
                gap |= data[at + p * wide].astype(np.int64) << 8 * p
            else:
                f |= data[at + p * wide].astype(np.int64) << 8 * (p - 4)
        total = np.cumsum(gap)
        before = np.concatenate(([0], total))[begin[x:y] - lo]
        place[lo:hi], freq[lo:hi] = total - np.repeat(before, n[x:y]), f
    return begin, place, freq


def inverse(df: DataFrame, n: DataFrame) -> DataFrame:
    """idf() from term, df."""
    total = n.columns[0]
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def count_of(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n"))


def weights(found: DataFrame, inverse: DataFrame) -> DataFrame:
    """The postings with weight = tf * idf."""
    return found.join(inverse.select("term", "df", "idf"), "term").withColumn("weight", F.col("tf") * F.col("idf"))


def norms(weighted: DataFrame, key: str = "node_id") -> DataFrame:
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def question_weights(questions: DataFrame, inverse: DataFrame, analyzer: Callable[[Column], Column] = tokens_fold) -> DataFrame:
    """question_id, term, weight of every question's terms; a term that the index lacks takes the idf of a plural or singular form, which then
    counts in the question's norm alone."""
    words = questions.select("question_id", F.explode(analyzer(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("freq"))
    words = words.withColumn("tf", F.col("freq") / F.greatest(F.max("freq").over(Window.partitionBy("question_id")), F.lit(1)))
    t = F.col("term")
    forms = F.array(
        F.struct(F.lit(0).alias("rank"), t.alias("form")),
        F.struct(F.lit(1).alias("rank"), F.when(t.endswith("es") & (F.length(t) > 4), F.expr("substring(term, 1, length(term) - 2)")).alias("form")),
        F.struct(F.lit(2).alias("rank"), F.when(t.endswith("s") & (F.length(t) > 3), F.expr("substring(term, 1, length(term) - 1)")).alias("form")),
        F.struct(F.lit(3).alias("rank"), F.when(~t.endswith("s"), F.concat(t, F.lit("s"))).alias("form")),
    )
    tried = words.withColumn("f", F.explode(forms)).where("f.form is not null")
    # the questions' few words go to the index, not the index to them
    found = inverse.where("idf != 0").select(F.col("term").alias("form"), "idf").join(F.broadcast(tried.select("question_id", "term", "tf", "f.rank", "f.form")), "form", "right")
    best = found.groupBy("question_id", "term", "tf").agg(F.min_by("idf", F.when(F.col("idf").isNotNull(), F.col("rank"))).alias("idf"))
    return best.select("question_id", "term", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("weight"))


def cosines(asked: DataFrame, weighted: DataFrame, lengths: DataFrame | None = None, key: str = "node_id") -> DataFrame:
    """question_id, key, score > 0: cosine of questions and nodes that share a term. asked is broadcast: it grows with the questions of a batch only.
    Without lengths weighted has each node's norm."""
    size = asked.groupBy("question_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    q = asked.join(size, "question_id").select("question_id", "term", F.col("weight").alias("q_weight"), "q_norm")
    own = [] if lengths is not None else ["norm"]
    products = weighted.select(key, "term", "weight", *own).join(F.broadcast(q), "term").groupBy("question_id", "q_norm", key, *own).agg(F.sum(F.col("weight") * F.col("q_weight")).alias("dot"))
    products = products if lengths is None else products.join(lengths, key)
    return products.select("question_id", key, (F.col("dot") / (F.col("q_norm") * F.col("norm"))).alias("score")).where("score > 0")


def ranked(scores: DataFrame, k: int, key: str = "node_id", tie: str | None = None) -> DataFrame:
    """The k best rows of every question, with their rank; ties go by key."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), tie or key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


