"""Queries over graphs: similarity edges, caps, traversal, retrieval, vectors, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors
from ..operators import community, edges, identity, index, maintain, reflect, report, retrieve, traverse
from ..schema import BACKWARD, CANDIDATES, DECAY, DEGREE, HOPS, MAX_DF
from ..shared import parts_of, settled, table
from .contract_text import _ASKED_SQL, POSTINGS_SQL, documents, indexed, questions
from .registry import query

_PAIRS_SQL = f"""{POSTINGS_SQL},
few AS (SELECT p.doc_id, p.term, p.term_idx FROM post p JOIN idfs i USING (term) WHERE i.df < {MAX_DF} AND i.df > 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, min(a.term_idx) AS first FROM few a JOIN few b ON a.term = b.term AND b.doc_id > a.doc_id GROUP BY ALL),
cand AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY first, b) AS rank FROM pair QUALIFY rank <= {CANDIDATES})"""
_NAMES_SQL = r"""ent AS (SELECT doc_id, list_distinct(list(entity)) AS es FROM (SELECT doc_id, strip_accents(lower(regexp_replace(w, '[^\p{L}]', '', 'g'))) AS entity, regexp_replace(w, '[^\p{L}]', '', 'g') AS raw, i
FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents))) WHERE i > 1 AND len(raw) > 2 AND regexp_full_match(raw, '\p{Lu}\p{Ll}+') AND raw NOT IN (NOTNAMES) GROUP BY doc_id)""".replace("NOTNAMES", ", ".join(f"'{w}'" for w in sorted(X.lexicon.NOT_NAMES)))
_EDGES_SQL = f"""{_PAIRS_SQL},
{_NAMES_SQL},
dots AS (SELECT c.a, c.b, sum(x.weight * y.weight) AS dot FROM cand c JOIN weighed x ON x.doc_id = c.a JOIN weighed y ON y.doc_id = c.b AND y.term = x.term GROUP BY ALL),
measured AS (SELECT c.a, c.b, c.rank, d.dot / (m.norm * n.norm) AS cosine, len(list_intersect(ea.es, eb.es)) / len(list_distinct(list_concat(ea.es, eb.es))) AS jaccard
FROM cand c JOIN dots d USING (a, b) JOIN lengths m ON m.doc_id = c.a JOIN lengths n ON n.doc_id = c.b LEFT JOIN ent ea ON ea.doc_id = c.a LEFT JOIN ent eb ON eb.doc_id = c.b),
sim AS (SELECT a, b, rank, CASE WHEN cosine >= 0.3 THEN 'similar-to' ELSE 'shares-entity' END AS type, round(CASE WHEN cosine >= 0.3 THEN cosine ELSE jaccard END, 6) AS weight FROM measured WHERE cosine >= 0.3 OR jaccard >= 0.2)"""


def similarity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, ord, rank, type, weight of the documents' similarity edges, before any cap."""
    own = indexed(spark, folder)
    docs = own.docs.withColumn("entities", X.EXTRACTORS["names"](F.col("content")))
    table = own.sent()
    if table is None:
        w = settled(own.weighed())
        pairs = settled(edges.candidates(w.select("doc_id", "term", "term_idx"), docs.select("doc_id", "ord"), key="doc_id"))
        scored = edges.pair_jaccard(edges.pair_cosine(pairs, w, "doc_id"), docs, "doc_id")
    else:
        scored = edges.compared(edges.candidates_by_number(docs, table, key="doc_id"), docs, table, own.words(), key="doc_id").withColumn("ord", F.col("a"))
    return edges.similarity(scored).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_PAIRS_SQL} SELECT a, b, rank FROM cand")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    own = indexed(spark, folder)
    table = own.sent()
    if table is None:
        return edges.candidates(index.postings(own.docs, key="doc_id"), own.docs.select("doc_id", "ord"), key="doc_id").select("a", "b", F.col("rank").cast("long").alias("rank"))
    return edges.candidates_by_number(own.docs, table, key="doc_id").select("a", F.posexplode("others").alias("rank", "b")).select("a", "b", (F.col("rank") + 1).cast("long").alias("rank"))


@query(f"WITH {_EDGES_SQL} SELECT a, b, type, weight FROM sim")
def similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_pairs(spark, folder).select("a", "b", "type", "weight")


@query(f"""WITH {_EDGES_SQL},
ends AS (SELECT a, b, weight, a AS e FROM sim UNION ALL SELECT a, b, weight, b FROM sim),
top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY weight DESC, a, b) AS k FROM ends) WHERE k <= {DEGREE} GROUP BY a, b HAVING count(*) = 2)
SELECT a, b, type, weight FROM sim JOIN top USING (a, b)""")
def degree_cap_mutual(spark: SparkSession, folder: str) -> DataFrame:
    return edges.cap_mutual(settled(similarity_pairs(spark, folder))).select("a", "b", "type", "weight")


@query()
def degree_cap_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential by nature; tests compare it with a plain loop."""
    return edges.cap_greedy(similarity_pairs(spark, folder)).select("a", "b", "type", "weight")


@query(r"""WITH term AS (SELECT item_id, lower(array_to_string(regexp_extract_all(text, '[\p{L}]+')[1:4], ' ')) AS t FROM benchmark)
SELECT DISTINCT item_id AS src, doc_id AS dst FROM term JOIN documents ON contains(lower(text), t) WHERE t <> ''""")
def defines_substring(spark: SparkSession, folder: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1), 1, 4)
    terms = table(spark, folder, "benchmark").select(F.col("item_id").alias("term_id"), F.array_join(words, " ").alias("term")).where("term != ''")
    found = edges.contained(terms, documents(spark, folder), "doc_id")
    return found.select(F.col("term_id").alias("src"), F.col("doc_id").alias("dst"))


# Vectors

_CENTRES_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
long AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL),
size AS (SELECT label, sqrt(sum(m * m)) AS s FROM long GROUP BY label),
centre AS (SELECT label AS question_id, list(m / s ORDER BY i) AS q FROM long JOIN size USING (label) GROUP BY label),
scored AS (SELECT question_id, vec_id, label, list_dot_product(e, q) AS score FROM v, centre)"""


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the labels' centres of unit length as questions."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    means = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    return v, means.select(F.col("label").alias("question_id"), F.transform("m", lambda x: x / vectors.norm(F.col("m"))).alias("vec"))


@query(f"WITH {_CENTRES_SQL} SELECT question_id, vec_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score >= 0.2) WHERE rank <= 16")
def knn_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    v, asked = _vectors(spark, folder)
    return retrieve.nearest(v, asked).select("question_id", F.col("node_id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CENTRES_SQL},
walked AS (SELECT question_id, vec_id, CASE WHEN label = question_id THEN 0.8 ELSE 0.2 END + (vec_id % 7) / 100 AS t, score FROM scored)
SELECT question_id, vec_id, round(0.5 * (t / max(t) OVER (PARTITION BY question_id)) + 0.5 * score, 5) AS score FROM walked""")
def hybrid_blend(spark: SparkSession, folder: str) -> DataFrame:
    v, asked = _vectors(spark, folder)
    walked = v.crossJoin(F.broadcast(asked.select("question_id"))).select("question_id", "node_id", (F.when(F.col("label") == F.col("question_id"), 0.8).otherwise(0.2) + F.col("node_id") % 7 / 100).alias("score"))
    return retrieve.blended(walked, v, asked).select("question_id", F.col("node_id").alias("vec_id"), F.round("score", 5).alias("score"))


@query(f"WITH {_CENTRES_SQL} SELECT x.question_id AS a, y.question_id AS b, round(list_dot_product(x.q, y.q), 5) AS cosine FROM centre x JOIN centre y ON x.question_id < y.question_id")
def centre_cosines(spark: SparkSession, folder: str) -> DataFrame:
    _, c = _vectors(spark, folder)
    other = c.select(F.col("question_id").alias("b"), F.col("vec").alias("w"))
    return c.select(F.col("question_id").alias("a"), "vec").join(other, F.col("a") < F.col("b")).select("a", "b", F.round(vectors.cosine(F.col("vec"), F.col("w")), 5).alias("cosine"))


# A graph of the tables: customers and suppliers in nations, nations in regions, suppliers and parts by what was sold.

_GRAPH_SQL = """d0 AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives' AS type, 0.8::DOUBLE AS weight FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'lives', 0.7::DOUBLE FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'within', 0.9::DOUBLE FROM nation),
dedge AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS ord FROM d0),
u0 AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, 'sold' AS type, least(round(sum(l_quantity) / 200, 6), 1)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
uedge AS (SELECT *, row_number() OVER (ORDER BY a, b) AS ord FROM u0)"""


def trade_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, folder, n)
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    d = t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("lives").alias("type"), F.lit(0.8).alias("weight"))
    d = d.unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("lives").alias("type"), F.lit(0.7).alias("weight")))
    d = d.unionByName(t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("within").alias("type"), F.lit(0.9).alias("weight")))
    lines = t("lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    sold = lines.repartition(parts_of(lines), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    u = sold.select(name("s", "l_suppkey").alias("a"), name("p", "l_partkey").alias("b"), F.lit("sold").alias("type"), F.least(F.round(F.col("q") / 200, 6), F.lit(1.0)).alias("weight"))
    # any unique order will do: an edge's ends name it
    return d.withColumn("ord", F.struct("src", "dst")), u.withColumn("ord", F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))


def _walk_sql(additive: bool = False, blocked: str = "false") -> str:
    """blocked: a condition on f.q and a.type under which a way is not gone."""
    out = f"""{_GRAPH_SQL},
adj AS (SELECT src, dst, type, weight, 0 AS class, 1.0::DOUBLE AS back, ord FROM dedge UNION ALL SELECT dst, src, type, weight, 1, {BACKWARD}::DOUBLE, ord FROM dedge
UNION ALL SELECT a, b, type, weight, 2, 1.0::DOUBLE, ord FROM uedge UNION ALL SELECT b, a, type, weight, 2, 1.0::DOUBLE, ord FROM uedge),
f0 AS (SELECT r_name AS q, 'r' || r_regionkey AS node, 1.0::DOUBLE AS score, 1 AS place FROM region), s0 AS (SELECT q, node, score FROM f0), v0 AS (SELECT q, node FROM f0)"""
    fold = "sum" if additive else "max"
    for k in range(HOPS):
        out += f""",
r{k} AS (SELECT f.q, a.dst AS node, f.score * {DECAY} * a.weight * a.back AS given, f.place, a.class, a.ord, coalesce(s.score, 0) AS had FROM f{k} f JOIN adj a ON a.src = f.node AND NOT ({blocked}) LEFT JOIN s{k} s ON s.q = f.q AND s.node = a.dst),
s{k + 1} AS (SELECT q, node, {fold}(score) AS score FROM (SELECT * FROM s{k} UNION ALL SELECT q, node, given FROM r{k}) GROUP BY ALL),
n{k} AS (SELECT q, node, given{" + had" if additive else ""} AS score, place, class, ord FROM r{k} WHERE {"true" if additive else "given > had"} QUALIFY row_number() OVER (PARTITION BY q, node ORDER BY place, class, ord) = 1),
f{k + 1} AS (SELECT q, node, score, row_number() OVER (PARTITION BY q ORDER BY place, class, ord) AS place FROM n{k} n WHERE NOT EXISTS (SELECT 1 FROM v{k} v WHERE v.q = n.q AND v.node = n.node)),
v{k + 1} AS (SELECT * FROM v{k} UNION ALL SELECT q, node FROM f{k + 1})"""
    return out


def _walked(spark: SparkSession, folder: str, additive: bool = False, everywhere: tuple[str, ...] = (), blocked: DataFrame | None = None) -> DataFrame:
    d, u = trade_graph(spark, folder)
    seeds = table(spark, folder, "region").select(F.col("r_name").alias("question_id"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return traverse.traverse(settled(traverse.adjacency(d, u, everywhere)), seeds, additive=additive, blocked=blocked)


@query(f"WITH {_walk_sql()} SELECT q AS question_id, node AS node_id, round(score, 6) AS score FROM s{HOPS}")
def bfs_scored(spark: SparkSession, folder: str) -> DataFrame:
    return _walked(spark, folder).withColumn("score", F.round("score", 6))


@query(f"WITH {_walk_sql(True)} SELECT q AS question_id, node AS node_id, round(score + 1e-9, 6) AS score FROM s{HOPS}")
def bfs_additive(spark: SparkSession, folder: str) -> DataFrame:
    return _walked(spark, folder, True).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@query(f"""WITH {_walk_sql(blocked="a.type = 'sold'")} SELECT q AS question_id, node AS node_id, round(score, 6) AS score FROM s{HOPS}""")
def bfs_blocked(spark: SparkSession, folder: str) -> DataFrame:
    return _walked(spark, folder, everywhere=("sold",)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_walk_sql(blocked="a.type = 'sold' AND f.q <> 'ASIA' OR a.type = 'lives' AND f.q = 'AFRICA'")} SELECT q AS question_id, node AS node_id, round(score, 6) AS score FROM s{HOPS}""")
def bfs_blocked_by_question(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "region").select(F.col("r_name").alias("question_id"))
    blocked = names.where("question_id != 'ASIA'").withColumn("type", F.lit("sold")).unionByName(names.where("question_id = 'AFRICA'").withColumn("type", F.lit("lives")))
    return _walked(spark, folder, blocked=blocked).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, way AS (SELECT dst AS src, src AS dst FROM dedge UNION ALL SELECT a, b FROM uedge),
walk AS (SELECT 'r' || r_regionkey AS node, 0 AS hop FROM region WHERE r_name = (SELECT min(r_name) FROM region) UNION SELECT w.dst, hop + 1 FROM walk JOIN way w ON w.src = walk.node WHERE hop < 3)
SELECT node AS node_id, min(hop) AS hop FROM walk GROUP BY node""")
def bfs_khop(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    ways = settled(d.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(u.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    regions = table(spark, folder, "region")
    root = regions.join(F.broadcast(regions.agg(F.min("r_name").alias("r_name"))), "r_name").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"))
    return traverse.reachable(ways, root, 3)


_TOP_SQL = f"""{_walk_sql()}, chosen AS (SELECT q, node, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, node) AS rank FROM s{HOPS} QUALIFY rank <= 20)"""


def _chosen(spark: SparkSession, folder: str) -> DataFrame:
    scores = _walked(spark, folder).withColumn("score", F.round("score", 9)).withColumn("ord", F.col("node_id"))
    return settled(traverse.top_nodes(scores))


@query(f"WITH {_TOP_SQL} SELECT x.q AS question_id, d.src, d.dst, d.type, d.weight FROM dedge d JOIN chosen x ON x.node = d.src JOIN chosen y ON y.node = d.dst AND y.q = x.q")
def induced_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    d, _ = trade_graph(spark, folder)
    return traverse.induced(d, _chosen(spark, folder)).select("question_id", "src", "dst", "type", "weight")


_LINES_SQL = f"""{_TOP_SQL}, line AS (SELECT q, 2 AS part, rank AS place, '[n' || rank || '|fact|' || printf('%.2f', round(score, 2)) || '|src:' || left(node, 1) || '] ' || node AS line FROM chosen
UNION ALL SELECT x.q, 3, row_number() OVER (PARTITION BY x.q ORDER BY d.src, d.dst), 'n' || x.rank || ' -[' || d.type || ':' || printf('%.1f', round(d.weight, 1)) || ']-> n' || y.rank FROM dedge d JOIN chosen x ON x.node = d.src JOIN chosen y ON y.node = d.dst AND y.q = x.q
UNION ALL SELECT x.q, 4, row_number() OVER (PARTITION BY x.q ORDER BY u.a, u.b), 'n' || x.rank || ' ~[' || u.type || ':' || printf('%.1f', round(u.weight, 1)) || ']~ n' || y.rank FROM uedge u JOIN chosen x ON x.node = u.a JOIN chosen y ON y.node = u.b AND y.q = x.q),
heads AS (SELECT DISTINCT q, part, -1 AS place, CASE part WHEN 2 THEN '--- NODES ---' WHEN 3 THEN '--- DIRECTED ---' ELSE '--- UNDIRECTED ---' END AS line FROM line),
top AS (SELECT q, 0 AS part, -1 AS place, '=== SUBGRAPH OF ' || count(*) FILTER (part = 2) || ' NODES AND ' || count(*) FILTER (part > 2) || ' EDGES ===' AS line FROM line GROUP BY q)"""


@query(f"WITH {_LINES_SQL} SELECT q AS question_id, string_agg(line, chr(10) ORDER BY part, place) AS text FROM (SELECT * FROM line UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM top) GROUP BY q")
def serialize_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """The text of the best subgraph of every region."""
    chosen = _chosen(spark, folder).withColumns({"type": F.lit("fact"), "section": F.substring("node_id", 1, 1), "content": F.col("node_id")})
    d, u = trade_graph(spark, folder)
    w = Window.partitionBy("question_id").orderBy("ord")
    place = lambda e: e.withColumn("ord", F.row_number().over(w).cast("long"))
    return retrieve.serialized(chosen, place(traverse.induced(d, chosen.select("question_id", "node_id"))), place(traverse.induced(u, chosen.select("question_id", "node_id"), ("a", "b"))))


@query("""WITH s AS (SELECT lang AS question_id, doc_id, source, n_chars AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS overall FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY overall) AS round, min(overall) OVER (PARTITION BY question_id, source) AS file_rank, count(*) OVER (PARTITION BY question_id) AS n FROM s)
SELECT question_id, doc_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN n > 40 THEN round END, CASE WHEN n > 40 THEN file_rank END, overall) AS rank FROM r) WHERE rank <= 40""")
def diversify_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "documents").select(F.col("lang").alias("question_id"), "doc_id", "source", F.col("n_chars").alias("score"))
    return retrieve.diversified(seeds, 40, "source", "doc_id").select("question_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(len(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 40000")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return retrieve.within_budget(docs, 40_000, ["source"], ["doc_id"], "text").select("source", "doc_id", "used")


_LANGS = ("de", "en", "es", "fr")


@query(f"""WITH {POSTINGS_SQL},\n{_ASKED_SQL}, d AS (SELECT CASE lang {' '.join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(_LANGS))} END AS graph_ord, d.doc_id, text, coalesce(score, 0) AS score FROM documents d LEFT JOIN (SELECT doc_id, score FROM scored WHERE question_id = 'q2') s ON s.doc_id = d.doc_id),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY graph_ord, doc_id) = 1)
SELECT graph_ord, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, graph_ord, doc_id) AS rank FROM f) WHERE rank <= 50""")
def federated_topk(spark: SparkSession, folder: str) -> DataFrame:
    """A graph for each language, asked the same question; the seeds are all that share a word with it."""
    own = indexed(spark, folder)
    asked = index.question_weights(questions(spark).where("question_id = 'q2'"), own.inverse)
    scores = own.scores(asked).select(F.col("doc_id").alias("node_id"), F.round("score", 9).alias("score"))
    docs = settled(table(spark, folder, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("content_hash"), "lang"))
    scores = settled(scores)
    parts = [(own := docs.where(F.col("lang") == x), scores.join(own, "node_id", "left_semi")) for x in _LANGS]
    return retrieve.federated(parts, 50).select("graph_ord", F.col("node_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Iterative; tests compare it with a plain loop."""
    return community.label_propagation(similarity_pairs(spark, folder).select("a", "b", "weight"))


@query(rf"""WITH {_EDGES_SQL},
named AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(\p{{Lu}}\p{{Ll}}+(?:[\s\-]\p{{Lu}}\p{{Ll}}+)+)', 1), lambda e: lower(e))) AS es FROM documents),
pairs AS (SELECT t.term, unnest(n.es) AS synonym, s.weight FROM sim s JOIN (SELECT doc_id, unnest(es) AS term FROM named) t ON t.doc_id = s.a JOIN named n ON n.doc_id = s.b WHERE s.weight >= 0.4),
swaps AS (SELECT term, synonym, round(sum(weight), 9) AS weight FROM pairs WHERE term <> synonym GROUP BY ALL)
SELECT term, synonym, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, synonym) AS rank FROM swaps) WHERE rank <= 5 AND weight > 0.5""")
def synonyms_top5(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that similar documents have in each other's place."""
    named = documents(spark, folder).select(F.col("doc_id").alias("node_id"), F.array_distinct(F.transform(X.EXTRACTORS["phrases"](F.col("content")), lambda e: F.lower(e))).alias("entities"))
    return identity.synonyms(similarity_pairs(spark, folder), named).withColumn("rank", F.col("rank").cast("long"))


# Reports over the documents as nodes and the trade graph

_NODES_SQL = """node AS (SELECT 'c' || c_custkey AS node_id, 'customer' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region UNION ALL SELECT 'p' || p_partkey, 'part' FROM part)"""


def trade_nodes(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("part", "p_partkey")):
        own = table(spark, folder, name).select(F.concat(F.lit(name[0]), F.col(key)).alias("node_id"), F.lit(name).alias("type"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {_GRAPH_SQL}, {_NODES_SQL}, rows AS (SELECT 'node' AS of, type FROM node UNION ALL SELECT 'directed', type FROM dedge UNION ALL SELECT 'undirected', type FROM uedge)
SELECT of, type, count(*) AS n FROM rows GROUP BY of, type UNION ALL SELECT of, NULL, count(*) FROM rows GROUP BY of""")
def type_counts(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    return report.type_counts(trade_nodes(spark, folder), d, u)


@query(f"""WITH {_GRAPH_SQL}, {_NODES_SQL}, ends AS (SELECT src AS e FROM dedge UNION SELECT dst FROM dedge UNION SELECT a FROM uedge WHERE weight >= 0.15 UNION SELECT b FROM uedge WHERE weight >= 0.15)
SELECT node_id, type FROM node WHERE node_id IN (SELECT e FROM ends)""")
def prune_orphans(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    return maintain.pruned(trade_nodes(spark, folder), d, u)[0]


@query(f"""WITH {_GRAPH_SQL}, e AS (SELECT src AS x, dst AS y, weight FROM dedge UNION ALL SELECT a, b, weight FROM uedge), b AS (SELECT x, y, weight FROM e UNION ALL SELECT y, x, weight FROM e),
m AS (SELECT x AS node_id, y AS other, max(weight) AS weight FROM b WHERE x <> y GROUP BY ALL)
SELECT node_id, other, weight, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, other) AS rank FROM m QUALIFY rank <= 8""")
def neighbourhood_top8(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    return report.neighbourhood(d, u).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_GRAPH_SQL}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1 AS d, 0 AS u FROM dedge UNION ALL SELECT least(a, b), greatest(a, b), 0, 1 FROM uedge), g AS (SELECT a, b, max(d) AS d, max(u) AS u FROM p GROUP BY ALL)
SELECT count(*) FILTER (d > u) AS directed, count(*) FILTER (u > d) AS undirected, count(*) FILTER (u = d) AS both, count(*) AS pairs FROM g""")
def pair_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return report.pair_coverage(*trade_graph(spark, folder))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(F.col("doc_id").alias("node_id"), "ord", F.col("source").alias("file"), F.col("source").alias("domain"), "content", X.EXTRACTORS["names"](F.col("content")).alias("entities"))


_RAW_NAMES_SQL = r"""raw AS (SELECT DISTINCT doc_id, source, e FROM (SELECT doc_id, source, i, regexp_replace(w, '[^\p{L}]', '', 'g') AS e FROM (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, source, string_split_regex(text, '\s+') AS ws FROM documents)))
WHERE i > 1 AND len(e) > 2 AND regexp_full_match(e, '\p{Lu}\p{Ll}+') AND e NOT IN (NOTNAMES))""".replace("NOTNAMES", ", ".join(f"'{w}'" for w in sorted(X.lexicon.NOT_NAMES)))


@query(f"WITH {_RAW_NAMES_SQL} SELECT e AS entity, count(*) AS mentions, count(DISTINCT raw.source) AS files, min(doc_id) AS first, max(doc_id) AS last, list(text ORDER BY doc_id)[1:20] AS facts FROM raw JOIN documents USING (doc_id) GROUP BY e HAVING count(*) >= 3 ORDER BY mentions DESC, entity LIMIT 100")
def entity_reports(spark: SparkSession, folder: str) -> DataFrame:
    return report.entity_reports(_named(spark, folder))


@query(f"""WITH {_RAW_NAMES_SQL}, low AS (SELECT DISTINCT doc_id, source, lower(e) AS e FROM raw)
SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, round(least(0.2 * count(*), 0.9)::DOUBLE, 6) AS surprise FROM low x JOIN low y ON x.e = y.e AND x.source <> y.source AND x.doc_id < y.doc_id
GROUP BY ALL HAVING count(*) >= 2 ORDER BY surprise DESC, a, b LIMIT 20""")
def discover_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Over all documents: no sample of each domain."""
    none = spark.createDataFrame([], "a long, b long")
    return reflect.discoveries(_named(spark, folder), none, sample=None).withColumn("surprise", F.round("surprise", 6))


@query()
def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Invented prose denies little; tests have the cases."""
    return reflect.contradictions(_named(spark, folder), indexed(spark, folder).weighed().withColumnRenamed("doc_id", "node_id"))


@query("""WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'supports' AS type, least(count(*) / 3, 1)::DOUBLE AS weight FROM lineitem GROUP BY ALL
UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, 'supports', 0.6 FROM lineitem GROUP BY ALL),
w AS (SELECT a.src, b.dst, a.weight * b.weight * 0.5 AS weight, a.dst AS mid FROM e a JOIN e b ON a.dst = b.src WHERE a.weight * b.weight * 0.5 >= 0.15)
SELECT src, dst, round(arg_min(weight, mid), 6) AS weight FROM w GROUP BY ALL""")
def transitive_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and orders by the parts between them; no cap on what is inferred."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    parts = parts_of(l)
    one = l.select("l_suppkey", "l_partkey").repartition(parts, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("supports").alias("type"), F.least(F.col("n") / 3, F.lit(1.0)).alias("weight"))
    two = l.select("l_partkey", "l_orderkey").repartition(parts, "l_partkey", "l_orderkey").distinct().select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst"), F.lit("supports").alias("type"), F.lit(0.6).alias("weight"))
    found = reflect.inferred(one.unionByName(two).withColumn("ord", F.struct("dst", "src")), most=None)
    return found.select("src", "dst", F.round("weight", 6).alias("weight"))
