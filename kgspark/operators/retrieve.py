"""From questions to subgraphs: seeds, their mixture, what is added to and taken from a result, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

SUMMARY, SUMMARY_BOOST, CHILD, SIBLING = "session-summary", 1.3, 0.5, 0.9
LEAST_SIMILARITY, EMBEDDED_SEEDS, BLEND = 0.2, 16, 0.5


def with_summaries(scores: DataFrame, types: DataFrame, prefer: bool | None | Column) -> DataFrame:
    """Summaries of sessions preferred (their scores raised), left out, or as they are (None or null). types: node_id, type. prefer: of all rows, or a
    column of the scores."""
    if prefer is None:
        return scores
    wish = F.lit(prefer) if isinstance(prefer, bool) else prefer
    summaries = types.where(F.col("type") == SUMMARY).select("node_id", F.lit(True).alias("__summary"))
    known = scores.join(summaries, "node_id", "left").withColumn("__summary", F.coalesce("__summary", F.lit(False)))
    kept = known.where(~F.col("__summary") | F.coalesce(wish, F.lit(True)))
    raised = F.col("__summary") & F.coalesce(wish, F.lit(False))
    return kept.withColumn("score", F.when(raised, F.col("score") * SUMMARY_BOOST).otherwise(F.col("score"))).select(scores.columns)


def nearest(vectors: DataFrame, asked: DataFrame, k: int = EMBEDDED_SEEDS, least: float = LEAST_SIMILARITY, key: str = "node_id") -> DataFrame:
    """question_id, key, score, rank: the k best unit vectors of every question. asked (question_id, vec) is broadcast; each question's best are
    taken in every partition before the exchange."""
    q = asked.select("question_id", F.col("vec").alias("q_vec"))
    scored = vectors.crossJoin(F.broadcast(q)).select("question_id", key, dot(F.col("vec"), F.col("q_vec")).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(*pools: DataFrame) -> DataFrame:
    """question_id, node_id, score: the best of all pools."""
    out = pools[0].select("question_id", "node_id", "score")
    for p in pools[1:]:
        out = out.unionByName(p.select("question_id", "node_id", "score"))
    return out.groupBy("question_id", "node_id").agg(F.max("score").alias("score"))


def diversified(seeds: DataFrame, cap: int | Column, group: str = "file", tie: str = "ord", mix: Column | None = None) -> DataFrame:
    """At most cap seeds of every question: where there are more and mix holds (it does if it is not given), in rounds of one of each file, files by
    their best seed; else the best. seeds: question_id, score, group, tie; a null group is one group of its own. cap and mix may be columns of them."""
    most = F.lit(cap) if isinstance(cap, int) else cap
    q = Window.partitionBy("question_id")
    own = seeds.withColumn("g", F.coalesce(F.col(group), F.lit("__unknown__"))).withColumn("overall", F.row_number().over(q.orderBy(F.desc("score"), tie)))
    by_file = Window.partitionBy("question_id", "g")
    own = own.withColumn("round", F.row_number().over(by_file.orderBy("overall"))).withColumn("file_rank", F.min("overall").over(by_file)).withColumn("n", F.count("*").over(q))
    apart = (F.col("n") > most) & (F.lit(True) if mix is None else F.coalesce(mix, F.lit(True)))
    mixed = q.orderBy(F.when(apart, F.col("round")), F.when(apart, F.col("file_rank")), "overall")
    return own.withColumn("rank", F.row_number().over(mixed)).where(F.col("rank") <= most).drop("g", "overall", "round", "file_rank", "n")


def blended(scores: DataFrame, vectors: DataFrame, asked: DataFrame, share: float = BLEND) -> DataFrame:
    """score = half the traversal's, by the question's largest, and half the similarity of the vectors (0 where a node has none)."""
    top = F.max("score").over(Window.partitionBy("question_id"))
    own = scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))
    q = asked.select("question_id", F.col("vec").alias("q_vec"))
    own = own.join(F.broadcast(q), "question_id", "left").join(vectors.select("node_id", "vec"), "node_id", "left")
    return own.withColumn("score", (1 - share) * F.col("score") + share * F.coalesce(dot(F.col("vec"), F.col("q_vec")), F.lit(0.0))).drop("vec", "q_vec")


def without_repetition(scores: DataFrame, dedges: DataFrame) -> DataFrame:
    """Scores of nodes whose summary is in the same result are halved."""
    pairs = dedges.where("type = 'summarizes'").select(F.col("src").alias("summary"), F.col("dst").alias("node_id"))
    own = scores.select("question_id", F.col("node_id").alias("summary"))
    children = pairs.join(own, "summary").select("question_id", "node_id").distinct().withColumn("child", F.lit(True))
    return scores.join(children, ["question_id", "node_id"], "left").withColumn("score", F.when(F.col("child"), F.col("score") * CHILD).otherwise(F.col("score"))).drop("child")


def siblings(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, node_id, score of what the user said in turns whose answers were chosen, where it was not: sections "Assistant (turn n)" and
    "User (turn n)" of one file."""
    turn = F.regexp_extract("section", r"\(turn ([0-9]+)\)$", 1)
    placed = nodes.where(F.col("section").rlike(r"^(User|Assistant) \(turn [0-9]+\)$")).select("node_id", "file", F.col("section").startswith("User").alias("user"), turn.alias("turn"))
    answers = chosen.join(placed.where("not user"), "node_id").select("question_id", "file", "turn", "score")
    users = placed.where("user").select("node_id", "file", "turn")
    found = answers.join(users, ["file", "turn"]).groupBy("question_id", "node_id").agg((F.max("score") * SIBLING).alias("score"))
    return found.join(chosen.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")


def within_budget(rows: DataFrame, budget: int, group: list[str], order: list[str], text: str = "content") -> DataFrame:
    """The first rows of each group until one does not fit into so many characters."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget)


def federated(parts: list[tuple[DataFrame, DataFrame]], k: int) -> DataFrame:
    """graph_ord, node_id, content_hash, score, rank of the best k of several graphs' nodes and seeds; of equal contents the first graph's stays,
    and a node that is no seed has the score 0. parts: nodes (node_id, ord, content_hash), seeds (node_id, score)."""
    rows = None
    for g, (nodes, seeds) in enumerate(parts):
        own = nodes.select("node_id", "ord", "content_hash").join(seeds.select("node_id", "score"), "node_id", "left")
        own = own.select(F.lit(g).alias("graph_ord"), "node_id", "ord", "content_hash", F.coalesce("score", F.lit(0.0)).alias("score"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("content_hash").orderBy("graph_ord", "ord"))).where("n = 1").drop("n")
    top = first.orderBy(F.desc("score"), "graph_ord", "ord").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "graph_ord", "ord"))).drop("ord")


CLAIMS, JOINT = 10, " || "


def serialized(chosen: DataFrame, dedges: DataFrame, uedges: DataFrame) -> DataFrame:
    """question_id, text: the subgraph as lines: a head with counts, summaries of sessions with up to ten claims, nodes, directed and undirected edges
    under short names. chosen: question_id, rank, score, type, section, content, node_id and, if there, metadata (sessionId, sessionDate, claims); edges:
    question_id beside their columns. Documents and sections take names, but no lines."""
    if "metadata" not in chosen.columns:
        chosen = chosen.withColumn("metadata", F.create_map().cast("map<string,string>"))
    meta = lambda k: F.element_at(F.col("metadata"), k)
    named = chosen.withColumn("name", F.concat(F.lit("n"), F.col("rank")))
    tag = lambda mark, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"|{mark}:"), value)).otherwise("")
    score = F.format_string("%.2f", F.round("score", 2))
    line = lambda part, text, at=F.col("rank").cast("long"): ("question_id", F.lit(part).alias("part"), at.alias("at"), text.alias("line"))
    said = F.slice(F.filter(F.transform(F.split(F.coalesce(meta("claims"), F.lit("")), r" \|\| "), F.trim), lambda c: c != ""), 1, CLAIMS)
    claims = F.when(F.size(said) > 0, F.concat(F.lit("\n  claims: "), F.array_join(said, " | "))).otherwise("")
    summary = F.concat(F.lit("["), "name", F.lit("|summary|"), score, tag("session", meta("sessionId")), tag("date", meta("sessionDate")), F.lit("] "), "content", claims)
    fact = F.concat(F.lit("["), "name", F.lit("|"), "type", F.lit("|"), score, tag("src", F.col("section")), tag("date", meta("sessionDate")), F.lit("] "), "content")
    lines = named.where(F.col("type") == SUMMARY).select(*line(1, summary)).unionByName(named.where(~F.col("type").isin("document", "section", SUMMARY)).select(*line(2, fact)))
    names = named.select("question_id", "node_id", "name")
    ends = lambda e, x, y: e.join(names.withColumnsRenamed({"node_id": x, "name": "from"}), ["question_id", x]).join(names.withColumnsRenamed({"node_id": y, "name": "to"}), ["question_id", y])
    label = F.concat(F.lit("["), F.col("type"), F.lit(":"), F.format_string("%.1f", F.round("weight", 1)), F.lit("]"))
    lines = lines.unionByName(ends(dedges, "src", "dst").select(*line(3, F.concat(F.col("from"), F.lit(" -"), label, F.lit("-> "), F.col("to")), F.col("ord"))))
    lines = lines.unionByName(ends(uedges, "a", "b").select(*line(4, F.concat(F.col("from"), F.lit(" ~"), label, F.lit("~ "), F.col("to")), F.col("ord"))))
    heads = F.element_at(F.array(*map(F.lit, ("--- SESSION SUMMARIES ---", "--- NODES ---", "--- DIRECTED ---", "--- UNDIRECTED ---"))), F.col("part"))
    headed = lines.unionByName(lines.select("question_id", "part").distinct().select("question_id", "part", F.lit(-1).cast("long").alias("at"), heads.alias("line")))
    n_edges = lines.groupBy("question_id").agg(F.count_if(F.col("part") > 2).alias("edges"))
    total = chosen.groupBy("question_id").agg(F.count("*").alias("nodes")).join(n_edges, "question_id", "left")
    top = total.select("question_id", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("at"), F.concat(F.lit("=== SUBGRAPH OF "), "nodes", F.lit(" NODES AND "), F.coalesce("edges", F.lit(0)), F.lit(" EDGES ===")).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "line")))
    return headed.unionByName(top).groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def insights(chosen: DataFrame, least: float = 0.1) -> DataFrame:
    """question_id, insights: what enrichment made of the chosen nodes (metadata synthesis) of at least this score, line by line."""
    own = chosen.withColumn("synthesis", F.element_at("metadata", "synthesis")).where((F.col("score") >= least) & F.col("synthesis").isNotNull())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "synthesis"))), lambda x: F.concat(F.lit("- [n"), x["rank"], F.lit("] "), x["synthesis"]))
    return own.groupBy("question_id").agg(F.concat(F.lit("--- INSIGHTS ---\n"), F.array_join(lines, "\n")).alias("insights"))


def labels(nodes: DataFrame, chars: int = 60) -> DataFrame:
    """node_id, type, label: nodes as pictures of a graph want them, contents cut to so many characters and dots."""
    return nodes.select("node_id", "type", F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content")).alias("label"))


def edge_view(dedges: DataFrame, uedges: DataFrame) -> DataFrame:
    """source, target, type, weight, directed: both edge sets as one list, as pictures of a graph want it."""
    d = dedges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "weight", F.lit(True).alias("directed"))
    u = uedges.select(F.col("a").alias("source"), F.col("b").alias("target"), "type", "weight", F.lit(False).alias("directed"))
    return d.unionByName(u)
