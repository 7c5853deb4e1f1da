"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source).  A budget of tokens runs down the tree by weights;
where a subtree cannot use its share (all its tokens in MAX_EPOCHS epochs), what is
missing goes to its siblings by their weights before it goes to its parent's siblings.
Each level is water-filling in closed form over one small window.  A leaf's budget is
whole epochs of all its documents and the token prefix of one more epoch, whose order
is a seeded hash: documents are taken while the tokens before them are less than the
rest of the budget.

Tokens here are runs of characters other than space, tab and line ends, at least 1 a
document.  Null lang or source is the value "none"; null and empty texts have 1 token.
Weights are arguments; those that are not given are 1.  A null doc_id is ordered by its text's
hash.  Rows that repeat are documents of their own: equal ids are ordered by a hash of the text
and then by all columns, so that equal rows are interchangeable.  An empty table gives an
empty result; other columns are handed on and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checkpoint

SHARE, MAX_EPOCHS, SEED = 0.8, 3, "mix-1"
TREE = ["domain", "lang_key", "source_key"]
#: Weights by the beginning of a leaf's path, where "*" stands for anything; of several that fit the one with the fewest "*" counts.
Weights = dict[tuple[str, ...], float]
#: What the queries mix by: domains of sources by the number in their name modulo 4, weights of domains and languages.
DOMAINS = ("web", "books", "code", "forum")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "forum": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
WEIGHTS: Weights = {(d,): w for d, w in DOMAIN_WEIGHTS.items()} | {("*", x): w for x, w in LANG_WEIGHTS.items()}
LEAVES = 200_000  # plan rows that may be broadcast, and rows of a table of weights


def weights_of(rows: DataFrame, most: int = LEAVES) -> Weights:
    """Weights from a table (domain, lang, source, weight), where null lang or source end the path; more rows than most are an error."""
    got = rows.select("domain", "lang", "source", F.col("weight").cast("double").alias("weight")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} weights")
    out: Weights = {}
    for r in got:
        path = tuple(r[:3][: next((k for k in range(3) if r[k] is None), 3)])
        if not path or r.weight is None or r.weight <= 0 or path in out:
            raise ValueError(f"a weight needs a path of its own and a positive number: {tuple(r)}")
        out[path] = r.weight
    return out


def _weight(weights: Weights, depth: int) -> Column:
    """The weight of a node at this depth of the tree, by the columns of its path."""
    own = sorted((p for p in weights if len(p) == depth), key=lambda p: (p.count("*"), p))
    out = F.lit(1.0)
    for path in reversed(own):
        fits = F.lit(True)
        for column, name in zip(TREE, path):
            fits = fits & (F.col(column) == name) if name != "*" else fits
        out = F.when(fits, float(weights[path])).otherwise(out)
    return out


def numbered_domain(source: Column) -> Column:
    """The domain of a source by the number that its name ends with."""
    number = F.pmod(F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("long"), F.lit(0)), F.lit(len(DOMAINS)))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number + 1).cast("int"))


def _keyed(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """The documents in one struct beside the tree's keys, tokens and what orders them: no column can clash."""
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("none")), F.coalesce(F.col("lang").cast("string"), F.lit("none"))
    own = numbered_domain(source) if domain is None else F.coalesce(domain.cast("string"), F.lit("none"))
    tokens = F.greatest(F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \t\n\r]+")), F.lit(0)), F.lit(1)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), _text_key(F.col("text"))))
    return docs.select(F.struct("*").alias("row"), own.alias("domain"), lang.alias("lang_key"), source.alias("source_key"), tokens.alias("tokens"), name.alias("name"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _fill(level: DataFrame, above: list[str], budget: Column) -> DataFrame:
    """alloc of each row of a level: min(cap, weight * water level) among the rows with equal columns above."""
    by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", *[c for c in TREE if c in level.columns])
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    w = level.withColumn("ratio", F.col("cap") / F.col("weight"))
    w = w.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("weight_from", F.sum("weight").over(by) - F.sum("weight").over(upto) + F.col("weight"))
    w = w.withColumn("level", (budget - F.col("cap_before")) / F.col("weight_from"))
    # in the order of ratio, rows are full as long as their ratio is at most the level they would have, which only falls after that
    w = w.withColumn("water", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(by))
    full = F.col("water").isNull() | (F.col("ratio") <= F.col("water"))
    return w.withColumn("alloc", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water"))).drop("ratio", "cap_before", "weight_from", "level", "water")


def budgets(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Weights = WEIGHTS) -> DataFrame:
    """domain, lang_key, source_key, tokens, budget of every leaf. leaves: rows with the tree's keys and tokens."""
    leaf = leaves.groupBy(*TREE).agg(F.sum("tokens").alias("tokens")).withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    lang = leaf.groupBy("domain", "lang_key").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights, 2))
    top = leaf.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("all")).withColumn("weight", _weight(weights, 1))
    top = top.withColumn("total", F.floor(F.sum("all").over(Window.partitionBy(F.lit(0))) * F.lit(share)).cast("double"))
    top = _fill(top, [], F.col("total")).select("domain", F.col("alloc").alias("given"))
    lang = _fill(lang.join(top, "domain"), ["domain"], F.col("given")).select("domain", "lang_key", F.col("alloc").alias("given"))
    leaf = _fill(leaf.withColumn("weight", _weight(weights, 3)).join(lang, ["domain", "lang_key"]), ["domain", "lang_key"], F.col("given"))
    return leaf.select(*TREE, "tokens", F.floor(F.col("alloc") + 1e-3).cast("long").alias("budget"))


def _order(epoch: Column, name: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), name))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: Weights = WEIGHTS, domain: Column | None = None) -> DataFrame:
    """The documents' columns, then mix_domain, mix_epoch and mix_tokens (in place of columns of these names); a document has a row for each epoch that
    takes it. domain: what the documents' domain is, over their columns; else numbered_domain() of the source."""
    keyed = _keyed(docs.drop("mix_domain", "mix_epoch", "mix_tokens"), domain)
    # tokens are counted once for the plan: what is kept of a document is its leaf, name and number
    light = checkpoint(keyed.select(*TREE, "tokens", "name"))
    counts = light.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    plan = budgets(counts, share, max_epochs, weights).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    # the hash's first digits cut a leaf's last epoch into slots: about one for each 64 documents
    plan = plan.join(counts.select(*TREE, "n"), TREE).withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n") / 64, F.lit(1.0))) / 4)).cast("int"))
    plan = checkpoint(plan.select(*TREE, "epochs", "rest", "digits"))
    leaves = plan.count()

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(bounded(plan, leaves, LEAVES), TREE).withColumn("key", _order(F.col("epochs"), F.col("name"), seed)).withColumn("slot", F.expr("substring(key, 1, digits)"))

    slots = placed(light).where("rest > 0").groupBy(*TREE, "rest", "slot").agg(F.sum("tokens").alias("in_slot"))
    before = F.sum("in_slot").over(Window.partitionBy(*TREE).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_slot")
    # the slot in which the prefix ends: slots before it are taken whole
    edge = slots.withColumn("before", before).where("before < rest").groupBy(*TREE).agg(F.max_by(F.struct("slot", "before"), "slot").alias("edge"))
    edge = checkpoint(edge.select(*TREE, F.col("edge.slot").alias("edge_slot"), F.col("edge.before").alias("edge_before")))
    own = placed(keyed).join(bounded(edge, leaves, LEAVES), TREE, "left")
    out = [F.col("row.*"), F.col("domain").alias("mix_domain"), F.col("epoch").cast("int").alias("mix_epoch"), F.col("tokens").alias("mix_tokens")]
    taken = F.when(F.col("slot") < F.col("edge_slot"), F.col("epochs") + 1).otherwise(F.col("epochs"))
    whole = own.withColumn("taken", taken.cast("int")).where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    last = own.where("slot = edge_slot").withColumn("text_key", _text_key(F.col("row.text")))
    w = Window.partitionBy(*TREE).orderBy("key", "text_key", F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("tokens").over(w) - F.col("tokens") + F.col("edge_before")).where("upto < rest").withColumn("epoch", F.col("epochs"))
    return whole.select(*out).unionByName(last.select(*out))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.items()) + " ELSE 1.0 END"


def _fill_sql(name: str, source: str, above: str, keys: str, budget: str) -> str:
    by = f"PARTITION BY {above}" if above else ""
    return f"""
{name}_a AS (SELECT *, cap / weight AS ratio FROM {source}),
{name}_b AS (SELECT *, ({budget} - (sum(cap) OVER ({by} ORDER BY ratio, {keys} ROWS UNBOUNDED PRECEDING) - cap))
    / (sum(weight) OVER ({by}) - sum(weight) OVER ({by} ORDER BY ratio, {keys} ROWS UNBOUNDED PRECEDING) + weight) AS lvl FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN ratio > lvl THEN lvl END) OVER ({by}) AS water FROM {name}_b),
{name} AS (SELECT * EXCLUDE (ratio, lvl, water), CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE weight * water END AS alloc FROM {name}_c)"""


#: mix(documents) without the text, in DuckDB.
MIX_SQL = f"""
WITH keyed AS (SELECT doc_id, lang, source, n_chars, text, coalesce(lang, 'none') AS lang_key, coalesce(source, 'none') AS source_key, coalesce(doc_id::VARCHAR, 'none:' || md5(coalesce(text, ''))) AS name,
    ['web', 'books', 'code', 'forum'][coalesce(try_cast(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1) AS BIGINT), 0) % 4 + 1] AS domain,
    greatest(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0), 1)::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang_key, source_key, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MAX_EPOCHS})::DOUBLE AS cap FROM keyed GROUP BY ALL),
top0 AS (SELECT domain, sum(cap) AS cap, floor(sum(sum(tokens)) OVER () * {SHARE})::DOUBLE AS total, {_case("domain", DOMAIN_WEIGHTS)}::DOUBLE AS weight FROM leaf GROUP BY domain),
{_fill_sql("top", "top0", "", "domain", "total")},
lang0 AS (SELECT l.*, t.alloc AS given, {_case("l.lang_key", LANG_WEIGHTS)}::DOUBLE AS weight FROM (SELECT domain, lang_key, sum(cap) AS cap FROM leaf GROUP BY ALL) l JOIN top t USING (domain)),
{_fill_sql("langs", "lang0", "domain", "lang_key", "given")},
leaf0 AS (SELECT f.*, g.alloc AS given, 1.0::DOUBLE AS weight FROM leaf f JOIN langs g USING (domain, lang_key)),
{_fill_sql("leaves", "leaf0", "domain, lang_key", "source_key", "given")},
plan AS (SELECT *, budget // tokens AS epochs, budget - (budget // tokens) * tokens AS rest FROM (SELECT domain, lang_key, source_key, tokens, floor(alloc + 1e-3)::BIGINT AS budget FROM leaves)),
placed AS (SELECT k.*, p.epochs, p.rest,
    sum(k.tokens) OVER (PARTITION BY domain, lang_key, source_key ORDER BY md5(concat('{SEED}', '|', p.epochs, '|', k.name)), md5(coalesce(k.text, '')) ROWS UNBOUNDED PRECEDING) - k.tokens AS upto
    FROM keyed k JOIN plan p USING (domain, lang_key, source_key))
SELECT doc_id, lang, source, n_chars, domain AS mix_domain, unnest(range(0, epochs + CASE WHEN upto < rest THEN 1 ELSE 0 END))::INTEGER AS mix_epoch, tokens AS mix_tokens FROM placed
"""
