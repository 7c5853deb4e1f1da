"""Edges of a graph as windows and joins over its nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, defined_term, folded, tokens_fold
from ..functions.tokens import per_row
from ..schema import CANDIDATES, DEGREE, MAX_DF, SHARED, SIMILAR, STRUCTURAL
from ..shared import settled
from . import index

#: Entries of vectors or sets (some 16 bytes each) that are sent to the pairs; beyond, both are exchanged.
VECTOR_TERMS = 2_000_000


def precedes(nodes: DataFrame, group: list[str], order: list[str], key: str = "node_id") -> DataFrame:
    """src, dst: each node after the one before it in its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return nodes.select(F.lag(key).over(w).alias("src"), F.col(key).alias("dst"), F.lit("precedes").alias("type"), F.lit(0.8).alias("weight")).where("src is not null")


def near(nodes: DataFrame, group: list[str], order: list[str], reach: int, key: str = "node_id") -> DataFrame:
    """a, b, gap: nodes of a group that are 1 to reach positions apart."""
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = F.array(*(F.struct(F.lit(k).alias("gap"), F.lead(key, k).over(w).alias("b")) for k in range(1, reach + 1)))
    return nodes.select(F.col(key).alias("a"), ahead.alias("ahead")).select("a", F.explode("ahead").alias("x")).select("a", "x.b", "x.gap").where("b is not null")


def linked(pairs: DataFrame) -> DataFrame:
    """Pairs in one direction, for comparison with others."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def co_occurs(nodes: DataFrame, group: list[str], order: list[str], taken: DataFrame | None = None, key: str = "node_id", reach: int = 3) -> DataFrame:
    """a, b, type, weight of near nodes that no edge links yet."""
    pairs = near(nodes, group, order, reach, key).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if taken is not None:
        pairs = pairs.join(linked(taken), ["a", "b"], "left_anti")
    return pairs.select("a", "b", F.lit("co-occurs").alias("type"), F.lit(0.4).alias("weight"))


def cites(nodes: DataFrame, titles: DataFrame, key: str = "node_id") -> DataFrame:
    """src, dst: links whose lower-case target, "_" read as blank, is a title; of equal titles the first by ord. titles: title, ord, key."""
    first = titles.groupBy(F.lower("title").alias("target")).agg(F.min_by(key, "ord").alias("dst"))
    out = nodes.select(F.col(key).alias("src"), F.explode("links").alias("link")).withColumn("target", F.replace(F.lower("link"), F.lit("_"), F.lit(" ")))
    return out.join(first, "target").where("src != dst").select("src", "dst", F.lit("cites").alias("type"), F.lit(0.7).alias("weight"), F.col("link").alias("evidence")).distinct()


def _grams(word: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.when(F.length(word) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda k: F.substring(word, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(terms: DataFrame, texts: DataFrame, key: str = "node_id") -> DataFrame:
    """term_id, key: texts (key, content) that contain a term (term_id, term) in lower case.

    Only equi-joins: a term is looked up by its anchor.  Of three words or more that is the longest inner word, which the text has as a word; else the
    longest word, which is part of one of the text's words, found among the different words of all texts by the rarest of its grams of up to three
    characters; of a term without words it is the first character."""
    split = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    t = terms.select("term_id", F.lower("term").alias("t")).where("t != ''").withColumn("ws", split(F.col("t")))
    t = t.withColumn("inner", F.when(F.size("ws") > 2, longest(F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(1)))))).withColumn("part", F.when(F.col("inner").isNull() & (F.size("ws") > 0), longest("ws")))
    t = settled(t.select("term_id", "t", "inner", "part"))
    own = texts.select(key, F.lower("content").alias("low"))
    worded = own.select(key, "low", F.explode(F.array_distinct(split(F.col("low")))).alias("word"))
    out = worded.join(t.where("inner is not null").select("term_id", "t", F.col("inner").alias("word")), "word").where(F.contains("low", "t")).select("term_id", key)
    parts = t.where("part is not null")
    if not parts.isEmpty():
        grams = lambda c: F.explode(F.flatten(F.array(*(_grams(c, n) for n in (1, 2, 3)))))
        vocabulary = settled(worded.select("word").distinct())
        asked = parts.select("term_id", "t", "part", F.explode(F.when(F.length("part") < 3, F.array("part")).otherwise(_grams(F.col("part"), 3))).alias("gram"))
        known = settled(vocabulary.select("word", grams(F.col("word")).alias("gram")).join(asked.select("gram").distinct(), "gram"))
        rare = asked.join(known.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("term_id", "t", "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        held = rare.join(known, "gram").where(F.contains("word", "part")).select("term_id", "t", "word")
        out = out.unionByName(worded.join(held, "word").where(F.contains("low", "t")).select("term_id", key))
    signs = t.where("part is null and inner is null")
    if not signs.isEmpty():
        marked = own.select(key, "low", F.explode(F.array_distinct(F.split("low", ""))).alias("sign"))
        out = out.unionByName(marked.join(signs.select("term_id", "t", F.substring("t", 1, 1).alias("sign")), "sign").where(F.contains("low", "t")).select("term_id", key))
    return out.distinct()


def defines(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """src, dst: definitions and the other nodes that name what they define."""
    terms = nodes.where("type = 'definition'").select(F.col(key).alias("term_id"), defined_term(F.col("content")).alias("term")).where("length(term) > 2")
    found = contained(terms, nodes, key)
    return found.where(F.col("term_id") != F.col(key)).select(F.col("term_id").alias("src"), F.col(key).alias("dst"), F.lit("defines").alias("type"), F.lit(0.6).alias("weight"))


def candidates(found: DataFrame, orders: DataFrame, max_df: int = MAX_DF, most: int = CANDIDATES, key: str = "node_id") -> DataFrame:
    """a, b, ord, rank: for each node the first most later nodes that share a term of fewer than max_df nodes, by the first shared term, then by ord
    and key.

    Frequent terms go before anything is collected.  Of a term's list each node needs its first most later members only, so a list of m nodes gives
    at most m * most pairs."""
    rare = found.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") < max_df) & (F.col("n") > 1)).select("term")
    terms = found.select(key, "term", "term_idx").join(orders.select(key, "ord"), key).join(rare, "term")
    lists = settled(terms.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ord", key, "term_idx"))).alias("all")))
    places = lists.select("term", F.size("all").alias("n"), F.posexplode("all").alias("place", "at")).select("term", "place", F.col(f"at.{key}").alias("a"), F.col("at.ord").alias("ord"), F.col("at.term_idx").alias("term_idx"), (F.col("n") - F.col("place") - 1).alias("behind"))
    # a term that has enough later members fills a node's places: its terms behind that one are not looked at
    last = places.where(F.col("behind") >= most).groupBy("a").agg(F.min("term_idx").alias("last"))
    kept = places.where("behind > 0").join(last, "a", "left").where("last is null or term_idx <= last")
    ends = kept.join(lists, "term").select("a", "ord", "term_idx", F.explode(F.slice("all", F.col("place") + 2, F.lit(most))).alias("other"))
    ends = ends.select("a", "ord", F.col(f"other.{key}").alias("b"), F.col("other.ord").alias("ord_b"), "term_idx")
    pairs = ends.groupBy("a", "ord", "b", "ord_b").agg(F.min("term_idx").alias("first"))
    w = Window.partitionBy("a").orderBy("first", "ord_b", "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("a", "b", "ord", "rank")


def sparse_vectors(weighted: DataFrame, key: str = "node_id") -> DataFrame:
    """key, terms (hashes, ascending), weights: a node's postings as one row."""
    rows = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))))
    return weighted.groupBy(key).agg(rows.alias("v")).select(key, F.transform("v", lambda x: x["t"]).alias("terms"), F.transform("v", lambda x: x["w"]).alias("weights"))


def pair_cosine(pairs: DataFrame, weighted: DataFrame, key: str = "node_id") -> DataFrame:
    """The pairs with cosine, 0 where they share no term. Each node's vector is one row, joined to both ends; products are summed over sorted arrays."""
    v = sparse_vectors(weighted, key)
    v = F.broadcast(v) if weighted.count() <= VECTOR_TERMS else v
    side = lambda x: v.select(F.col(key).alias(x), F.col("terms").alias(f"terms_{x}"), F.col("weights").alias(f"weights_{x}"))
    names = pairs.columns
    schema = pairs.withColumn("cosine", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = []
            for c in ("terms_a", "weights_a", "terms_b", "weights_b"):
                x = batch.column(c)
                arrays.append((x.offsets.to_numpy(), x.values.to_numpy(), np.asarray(x.is_valid())))
            (ta, va, oka), (_, wa, _), (tb, vb, okb), (_, wb, _) = arrays
            out = np.zeros(batch.num_rows)
            for i in np.flatnonzero(oka & okb).tolist():
                x, p, y, q = va[ta[i] : ta[i + 1]], wa[ta[i] : ta[i + 1]], vb[tb[i] : tb[i + 1]], wb[tb[i] : tb[i + 1]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                size = np.sqrt((p @ p) * (q @ q))
                if size > 0:
                    out[i] = (p * q[at] * (y[at] == x)).sum() / size
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], names=[*names, "cosine"])

    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*names, "terms_a", "weights_a", "terms_b", "weights_b").mapInArrow(run, schema)


def pair_jaccard(pairs: DataFrame, entities: DataFrame, key: str = "node_id") -> DataFrame:
    """The pairs with jaccard of their entities, folded. entities: key, entities."""
    sets = entities.select(key, F.array_distinct(F.transform("entities", folded)).alias("own"))
    total = entities.agg(F.sum(F.size("entities") + 1)).first()[0] or 0
    sets = F.broadcast(sets) if total <= VECTOR_TERMS else sets
    for side in "ab":
        pairs = pairs.join(sets.select(F.col(key).alias(side), F.col("own").alias(f"own_{side}")), side, "left")
    both = F.size(F.array_intersect("own_a", "own_b"))
    whole = F.size(F.array_union("own_a", "own_b"))
    return pairs.withColumn("jaccard", F.when(whole > 0, both / whole).otherwise(0.0)).drop("own_a", "own_b")


#: Words (of all nodes of two blocks some 12 bytes each) that a block of nodes may have; blocks at least.
BLOCK_WORDS, BLOCKS = 50_000_000, 5
#: Nodes whose last terms are sent to the tasks; beyond, they are joined by an exchange.
SENT_NODES = 4_000_000


def _whole(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted batches, cut so that rows of one value in the column are together; of a value beyond the first most rows some may be left out."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        t = t.combine_chunks()
        value = t.column(column).to_numpy()
        cut = int(np.searchsorted(value, value[-1]))
        held = t.slice(cut) if most is None else t.slice(cut, most)
        if cut:
            yield from t.slice(0, cut).to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return (key ^ (key >> 12) ^ (key >> 24)) % blocks


def _neighbours(entries: DataFrame, n: int, max_df: int, most: int) -> DataFrame:
    """a, others: candidates() of nodes whose key is a number that also orders them. entries: key, word, term_idx.

    One exchange by word; of it, first, the term of each node that alone fills its places, then the words' lists, for each node up to that term. What is
    exchanged after are a node's own later neighbours in these few lists."""
    parts = max(entries.sparkSession.sparkContext.defaultParallelism, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * 100 // 2_000_000)
    placed = entries.select("word", "key", "term_idx").repartition(parts, "word")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in _whole(batches, 0, max_df):
            runs, of = per_row(batch.column(0).to_numpy())
            size = np.diff(np.append(runs, batch.num_rows))
            behind = (runs + size - 1)[of] - np.arange(batch.num_rows)
            yield batch, np.where((size < max_df)[of], behind, 0)

    def lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, behind in lists(batches):
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(behind >= most)) for c in (batch.column(1), batch.column(2))], names=["key", "last"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, behind in lists(batches):
            idx, last = batch.column(2).to_numpy(), batch.column(3).fill_null(2**31 - 1).to_numpy()
            at = np.flatnonzero((behind > 0) & (idx <= last))
            key, count = batch.column(1).to_numpy(), np.minimum(behind[at], most)
            for x in range(0, len(at), 20_000):
                a, c = at[x : x + 20_000], count[x : x + 20_000]
                cuts = np.concatenate(([0], np.cumsum(c)))
                others = key[np.repeat(a + 1 - cuts[:-1], c) + np.arange(cuts[-1])]
                yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(idx[a]), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(others))], names=["a", "term_idx", "others"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, 0):
            others = batch.column(2)
            size, b = others.value_lengths().to_numpy(), others.flatten().to_numpy()
            runs, of = per_row(np.repeat(batch.column(0).to_numpy(), size))  # by term_idx, then by key
            order = np.lexsort((np.arange(len(b)), b, of))
            seen = np.concatenate(([False], (b[order][1:] == b[order][:-1]) & (of[order][1:] == of[order][:-1])))
            kept = np.sort(order[~seen])
            runs, of = per_row(of[kept])
            rank = np.arange(len(kept)) - runs[of]
            kept, of = kept[rank < most], of[rank < most]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(of)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column(0).to_numpy())), pa.ListArray.from_arrays(pa.array(cuts), pa.array(b[kept]))], names=["a", "others"])

    last = placed.sortWithinPartitions("word", "key").mapInArrow(lasts, "key bigint, last int").groupBy("key").agg(F.min("last").alias("last"))
    known = placed.join(F.broadcast(last) if n <= SENT_NODES else last, "key", "left").select("word", "key", "term_idx", "last")
    ends = (known if n <= SENT_NODES else known.repartition(parts, "word")).sortWithinPartitions("word", "key").mapInArrow(later, "a bigint, term_idx int, others array<bigint>")
    return ends.repartition(parts, "a").sortWithinPartitions("a", "term_idx").mapInArrow(first, "a bigint, others array<bigint>")


def candidates_by_number(nodes: DataFrame, table: index.Sent, analyzer: Analyzer = tokens_fold, max_df: int = MAX_DF, most: int = CANDIDATES, key: str = "ord", text: str = "content", others: int = 0) -> DataFrame:
    """a, others: candidates() of nodes by a number that names and orders them, others in the order of their rank. others: how many more nodes than
    these the table was made of; a term's nodes are counted among these only."""
    own = nodes.withColumn(key, F.col(key).cast("long"))
    return _neighbours(index.rare(own, table, max_df + others, analyzer, key, text).withColumnRenamed(key, "key"), table.n, max_df, most)


def compared(pairs: DataFrame, nodes: DataFrame, table: index.Sent, words: int, analyzer: Analyzer = tokens_fold, similar: float = SIMILAR, shared: float = SHARED, key: str = "ord", text: str = "content") -> DataFrame:
    """a, b, rank, cosine, jaccard of the pairs (a, others) that reach one of the bounds. nodes: key, text, entities. words: of all nodes together.

    Nodes are packed (some two bytes a term, eight an entity) and stand in blocks; a task has two blocks and the pairs between them. So a node is exchanged
    once for each block, not once for each of its pairs: BLOCKS times, or as often as BLOCK_WORDS goes into all words."""
    blocks = max(BLOCKS, -(-words // BLOCK_WORDS)) | 1
    names = F.transform(F.array_distinct(F.transform(F.coalesce("entities", F.array().cast("array<string>")), folded)), lambda e: F.xxhash64(e))
    own = index.packed(nodes.select(F.col(key).cast("long").alias("key"), text, names.alias("names")), table, analyzer, "key", text, ("names",))
    place = F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", 12)).bitwiseXOR(F.shiftright("key", 24)), F.lit(blocks))
    group = lambda a, b: F.least(a, b) * blocks + F.greatest(a, b)
    vectors = own.withColumn("own", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("task", group(F.col("own"), F.col("other"))).drop("own", "other")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, b = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            a = batch.column(0).to_numpy()[row]
            rank = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size) + 1
            x, y = _block(a, blocks), _block(b, blocks)
            task = np.minimum(x, y) * blocks + np.maximum(x, y)
            order = np.lexsort((rank, a, task))
            runs, of = per_row(task[order] * (batch.num_rows + 1) + row[order])
            cuts = pa.array(np.append(runs, len(b)).astype(np.int32))
            at = order[runs]
            yield pa.RecordBatch.from_arrays([pa.array(task[at]), pa.array(a[at]), pa.ListArray.from_arrays(cuts, pa.array(b[order])), pa.ListArray.from_arrays(cuts, pa.array(rank[order].astype(np.int32)))], names=["task", "a", "others", "ranks"])

    asked = pairs.mapInArrow(split, "task bigint, a bigint, others array<bigint>, ranks array<int>")

    def products(held: pa.Table, pairs: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("rank", pa.int32()), ("cosine", pa.float64()), ("jaccard", pa.float64())])
        if not held.num_rows or not pairs.num_rows:
            return schema.empty_table()
        held = held.sort_by("key").combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        key, norm, top = (held.column(c).to_numpy() for c in ("key", "norm", "top"))
        begin, place, freq = index.unpacked(one(held, "terms"))
        name_size, name = one(held, "names").value_lengths().to_numpy().astype(np.int64), one(held, "names").flatten().to_numpy()
        name_begin = np.concatenate(([0], np.cumsum(name_size)))
        different, name = np.unique(name, return_inverse=True)
        # idf by place, and an array each in which one node's terms and names are marked
        idf = np.empty(len(table.of.value[1]))
        idf[table.of.value[2]] = table.idf(table.of.value[1].astype(np.int64))
        dense, mark = np.zeros(len(idf)), np.zeros(len(different), np.int64)
        pairs = pairs.combine_chunks()
        a_at = np.searchsorted(key, pairs.column("a").to_numpy())
        lists, ranks = one(pairs, "others"), one(pairs, "ranks").flatten().to_numpy()
        cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        b = lists.flatten().to_numpy()
        b_at = np.searchsorted(key, b)

        def spans(begin: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = begin[of + 1] - begin[of]
            ends = np.cumsum(n)
            return np.repeat(begin[of] - ends + n, n) + np.arange(ends[-1]), np.repeat(np.arange(len(of)), n)

        out: list[tuple] = []
        for i, x in enumerate(a_at.tolist()):
            of = b_at[cut[i] : cut[i + 1]]
            mine = slice(begin[x], begin[x + 1])
            w = idf[place[mine]]
            dense[place[mine]] = freq[mine] / top[x] * w * w
            at, k = spans(begin, of)
            cosine = np.bincount(k, freq[at] * dense[place[at]], len(of)) / top[of] / (norm[x] * norm[of])
            dense[place[mine]] = 0
            jaccard = np.zeros(len(of))
            if name_size[x]:
                mine = name[name_begin[x] : name_begin[x + 1]]
                mark[mine] = 1
                at, k = spans(name_begin, of)
                both = np.bincount(k, mark[name[at]], len(of))
                mark[mine] = 0
                jaccard = both / (name_size[x] + name_size[of] - both)
            good = np.flatnonzero((cosine >= similar) | (jaccard >= shared))
            if len(good):
                out.append((np.full(len(good), key[x]), key[of[good]], ranks[cut[i] + good], cosine[good], jaccard[good]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema) if out else schema.empty_table()

    return vectors.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(products, "a bigint, b bigint, rank int, cosine double, jaccard double")


def similarity(pairs: DataFrame, similar: float = SIMILAR, shared: float = SHARED) -> DataFrame:
    """a, b, type, weight: similar-to from the cosine, else shares-entity from the Jaccard index; ord and rank stay, if there."""
    kind = F.when(F.col("cosine") >= similar, "similar-to").when(F.col("jaccard") >= shared, "shares-entity")
    weight = F.when(F.col("cosine") >= similar, F.col("cosine")).otherwise(F.col("jaccard"))
    return pairs.withColumn("type", kind).withColumn("weight", weight).where("type is not null").drop("cosine", "jaccard")


def cap_mutual(pairs: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Edges that are among the degree heaviest of both ends; scales, and bounds degrees as the greedy cap does."""
    ends = pairs.select(F.posexplode(F.array("a", "b")).alias("side", "end"), "a", "b", "weight")
    w = Window.partitionBy("end").orderBy(F.desc("weight"), "a", "b")
    top = ends.withColumn("place", F.row_number().over(w)).where(F.col("place") <= degree)
    both = top.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
    return pairs.join(both, ["a", "b"])


def cap_greedy(pairs: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The sequential rule exactly: in the order of (ord, rank) an edge is taken while its first node has room and if its second has.

    Each decision depends on those before, so one task makes them all, in one pass with a counter a node; the default for graphs of one
    machine, while cap_mutual() is that for larger ones."""
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                ok = held.get(a, 0) < degree and held.get(b, 0) < degree
                if ok:
                    held[a] = held.get(a, 0) + 1
                    held[b] = held.get(b, 0) + 1
                keep.append(ok)
            yield batch.filter(pa.array(keep))

    return pairs.repartition(1).sortWithinPartitions("ord", "rank").mapInArrow(run, schema)


def content_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("type").isin(*STRUCTURAL))
