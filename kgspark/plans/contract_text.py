"""Queries over texts: analyzers, index, seeds, sentences, chunks, kinds, entities, pages, conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as X
from ..operators import edges, identity, index, retrieve
from ..shared import settled, spread, table
from ..sources import conversation, html, tabular
from .registry import query

STOP_SQL = ", ".join(f"'{w}'" for w in sorted(w for w in lexicon.ALL_STOPWORDS if w.isascii() and len(w) > 1))
#: One row a token of the folded text: doc_id, pos, term.
TOKENS_SQL = rf"""tok AS (SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM
(SELECT doc_id, string_split_regex(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+') AS ws FROM documents)) WHERE len(term) > 1 AND term NOT IN ({STOP_SQL}))"""
POSTINGS_SQL = f"""{TOKENS_SQL},
own AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS first FROM tok GROUP BY ALL),
post AS (SELECT doc_id, term, freq, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS term_idx, freq / max(freq) OVER (PARTITION BY doc_id) AS tf FROM own),
total AS (SELECT count(*) AS n FROM documents),
idfs AS (SELECT term, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM post, total GROUP BY term),
weighed AS (SELECT p.doc_id, p.term, p.term_idx, p.tf * i.idf AS weight FROM post p JOIN idfs i USING (term)),
lengths AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weighed GROUP BY doc_id)"""
QUESTIONS = [("q1", "What was the attribution of these things and the nations?"), ("q2", "Is the version of the licenses public?"), ("q3", "Wie ist die Freiheit der Einheit?")]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as nodes."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.col("text").alias("content"), "lang", "source")
    return spread(docs, "doc_id")


@dataclass(frozen=True)
class Index:
    """Document frequencies of the documents, and weights looked up by them."""

    docs: DataFrame
    inverse: DataFrame
    n: int

    def weighed(self, **which: object) -> DataFrame:
        return index.weighed(self.docs, self.inverse, self.n, key="doc_id", **which)

    def sent(self) -> index.Sent | None:
        """The terms for the tasks; None where a document's key repeats, too."""
        return None if index.repeats(self.docs, "doc_id") else index.sent(self.inverse, self.n)

    def words(self) -> int:
        """How many different words all documents have, each counted by itself."""
        return self.inverse.agg(F.sum("df")).first()[0] or 0

    def scores(self, asked: DataFrame) -> DataFrame:
        """question_id, doc_id, score of weighted questions."""
        asked = settled(asked)
        return index.cosines(asked, self.weighed(only=sorted({r.term for r in asked.select("term").distinct().collect()})), key="doc_id")


def indexed(spark: SparkSession, folder: str) -> Index:
    docs = documents(spark, folder)
    n = index.count_of(docs)
    return Index(docs, settled(index.inverse(index.frequencies(docs, key="doc_id"), n)), n.first()[0])


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id string, question string")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL")
def tokens_fold(spark: SparkSession, folder: str) -> DataFrame:
    return index.counted(documents(spark, folder), X.tokens_fold, "doc_id")


@query(r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+')) AS term FROM documents) WHERE len(term) > 1 GROUP BY ALL")
def tokens_unicode(spark: SparkSession, folder: str) -> DataFrame:
    return index.counted(documents(spark, folder), X.tokens_unicode, "doc_id")


_DE = ", ".join(f"'{w}'" for w in sorted(lexicon.STOPWORDS["de"]))


@query(rf"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+')) AS term FROM documents) WHERE len(term) > 1 AND term NOT IN ({_DE}) GROUP BY ALL")
def tokens_locale_de(spark: SparkSession, folder: str) -> DataFrame:
    return index.counted(documents(spark, folder), X.locale("de"), "doc_id")


@query(f"WITH {TOKENS_SQL} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term")
def vocab_df(spark: SparkSession, folder: str) -> DataFrame:
    return index.frequencies(documents(spark, folder), key="doc_id")


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, term, freq, term_idx, round(tf, 6) AS tf FROM post")
def tf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return index.postings(documents(spark, folder), key="doc_id").select("doc_id", "term", "freq", F.col("term_idx").cast("long").alias("term_idx"), F.round("tf", 6).alias("tf"))


@query(f"WITH {POSTINGS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def idf_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return index.inverse(index.frequencies(docs, key="doc_id"), index.count_of(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weighed) WHERE rank <= 5")
def tfidf_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return indexed(spark, folder).weighed(most=5).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("doc_id", "term", F.round("weight", 6).alias("weight"), "rank")


_ASKED_SQL = (
    "asked0 AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ") AS v(question_id, question)),\n"
    rf"""asked AS (SELECT question_id, term, count(*) AS freq FROM (SELECT question_id, unnest(string_split_regex(regexp_replace(strip_accents(lower(question)), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS term FROM asked0)
WHERE len(term) > 1 AND term NOT IN ({STOP_SQL}) GROUP BY ALL),
qw AS (SELECT a.question_id, a.term, a.freq / max(a.freq) OVER (PARTITION BY a.question_id) * coalesce(i0.idf, i1.idf, i2.idf, i3.idf, 0) AS weight FROM asked a
LEFT JOIN idfs i0 ON i0.term = a.term
LEFT JOIN idfs i1 ON a.term LIKE '%es' AND len(a.term) > 4 AND i1.term = left(a.term, len(a.term) - 2)
LEFT JOIN idfs i2 ON a.term LIKE '%s' AND len(a.term) > 3 AND i2.term = left(a.term, len(a.term) - 1)
LEFT JOIN idfs i3 ON a.term NOT LIKE '%s' AND i3.term = a.term || 's'),
qn AS (SELECT question_id, sqrt(sum(weight * weight)) AS q_norm FROM qw GROUP BY question_id),
scored AS (SELECT q.question_id, w.doc_id, sum(q.weight * w.weight) / (any_value(n.q_norm) * any_value(l.norm)) AS score
FROM qw q JOIN weighed w USING (term) JOIN qn n USING (question_id) JOIN lengths l USING (doc_id) GROUP BY q.question_id, w.doc_id HAVING score > 0)"""
)


@query(f"WITH {POSTINGS_SQL},\n{_ASKED_SQL}\nSELECT question_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5")
def seed_topk(spark: SparkSession, folder: str) -> DataFrame:
    own = indexed(spark, folder)
    scores = own.scores(index.question_weights(questions(spark), own.inverse)).withColumn("score", F.round("score", 9))
    return index.ranked(scores, 5, "doc_id").select("question_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POSTINGS_SQL},\n{_ASKED_SQL}\nSELECT question_id, term, round(weight, 6) AS weight FROM qw")
def seed_plural_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return index.question_weights(questions(spark), indexed(spark, folder).inverse).select("question_id", "term", F.round("weight", 6).alias("weight"))


_T = X.TERMINATORS
SENTENCES_SQL = rf"""sent AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, trim(unnest(ps), ' ') AS s, generate_subscripts(ps, 1) AS i
FROM (SELECT doc_id, string_split(regexp_replace(text, '([{_T}])\s*', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)) WHERE s <> '')"""


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, (k - 1)::BIGINT AS pos, s AS sentence FROM sent")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.posexplode(X.sentences(F.col("content"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH RECURSIVE {SENTENCES_SQL},
pack AS (SELECT doc_id, k, s AS open, 1 AS n, len(s) > {X.MAX_CHUNK} AS full, 0 AS chunk FROM sent WHERE k = 1
UNION ALL SELECT t.doc_id, t.k, CASE WHEN p.full THEN t.s ELSE p.open || ' ' || t.s END, CASE WHEN p.full THEN 1 ELSE p.n + 1 END,
CASE WHEN p.full THEN len(t.s) > {X.MAX_CHUNK} ELSE p.n + 1 >= {X.MAX_SENTENCES} OR len(p.open) + 1 + len(t.s) > {X.MAX_CHUNK} END, p.chunk + CASE WHEN p.full THEN 1 ELSE 0 END
FROM pack p JOIN sent t ON t.doc_id = p.doc_id AND t.k = p.k + 1)
SELECT doc_id, chunk::BIGINT AS chunk, arg_max(open, k) AS content FROM pack GROUP BY doc_id, chunk"""
)
def chunk_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = X.packed(X.sentences(F.col("content")))
    return documents(spark, folder).select("doc_id", F.posexplode(packed).alias("chunk", "content")).withColumn("chunk", F.col("chunk").cast("long"))


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, (k - 1)::BIGINT AS pos, {X.kind_sql('s')} AS kind FROM sent")
def chunk_classify(spark: SparkSession, folder: str) -> DataFrame:
    parts = documents(spark, folder).select("doc_id", F.posexplode(X.sentences(F.col("content"))).alias("pos", "s"))
    return X.kinds(parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("s").alias("kind")), "kind")


def _entity_query(name: str, pattern: str, extractor: str | None = None, where: str = "") -> None:
    sql = rf"SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS entity FROM documents) {where}"

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return documents(spark, folder).select("doc_id", F.explode(X.EXTRACTORS[extractor or name](F.col("content"))).alias("entity")).distinct()

    query(sql, f"entities_{name}")(run)


_entity_query("years", r"\b(1[0-9]{3}|20[0-9]{2})\b")
_entity_query("phrases", r"(\p{Lu}\p{Ll}+(?:[\s\-]\p{Lu}\p{Ll}+)+)")
_entity_query("acronyms", r"\b(\p{Lu}{2,})\b", where="WHERE entity NOT IN (" + ", ".join(f"'{w}'" for w in sorted(lexicon.NOT_ACRONYMS)) + ")")
_entity_query("emails", r"\b([\w.+-]+@[\w.-]+\.\w{2,})\b")
_entity_query("day_dates", r"\b(\d{1,2}[./]\d{1,2}[./]\d{2,4})\b")
_entity_query("dotted", r"\b(\w+(?:\.\w+)+)\b")
_entity_query("measures", r"\b(\d+(?:[.,]\d+)?\s*(?:" + "|".join(X.UNITS) + r"))\b")
_entity_query("parenthesised", r"\(([^)]{2,60})\)", where=r"WHERE regexp_matches(entity, '\p{L}')")


@query(r"""SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, entity[2:len(entity) - 1] AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '("[^"]+"|''[^'']+''|«[^»]+»|„[^“]+“|「[^」]+」|『[^』]+』|“[^”]+”)', 1)) AS entity FROM documents)) WHERE len(entity) > 1 AND len(entity) < 100""")
def entities_quoted(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.explode(X.EXTRACTORS["quoted"](F.col("content"))).alias("entity")).distinct()


@query(
    r"""SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, i, regexp_replace(w, '[^\p{L}]', '', 'g') AS entity FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents)))
WHERE i > 1 AND len(entity) > 2 AND regexp_full_match(entity, '\p{Lu}\p{Ll}+') AND entity NOT IN (""" + ", ".join(f"'{w}'" for w in sorted(lexicon.NOT_NAMES)) + ")"
)
def entities_names(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.explode(X.EXTRACTORS["names"](F.col("content"))).alias("entity")).distinct()


@query()
def entities_all(spark: SparkSession, folder: str) -> DataFrame:
    """All extractors at once; RE2 lacks the lookarounds of some."""
    return documents(spark, folder).select("doc_id", X.entities(F.col("content")).alias("entities"))


_MENTIONS_SQL = r"mention AS (SELECT DISTINCT doc_id, regexp_replace(e, '\s+', ' ', 'g') AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(\p{Lu}\p{Ll}+(?:[\s\-]\p{Lu}\p{Ll}+)+)', 1)) AS e FROM documents) WHERE regexp_full_match(e, '\p{Lu}\p{Ll}+(\s+\p{Lu}\p{Ll}+)+'))"


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("entities", X.EXTRACTORS["phrases"](F.col("content")))
    return identity.mentions(docs, "doc_id")


@query(f"WITH {_MENTIONS_SQL} SELECT name, count(*) AS mentions, min(doc_id) AS first, max(doc_id) AS last, round(least(0.5 + 0.1 * count(*), 0.95)::DOUBLE, 6) AS confidence FROM mention GROUP BY name")
def person_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return identity.persons(_mentions(spark, folder), key="doc_id").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_MENTIONS_SQL} SELECT a.name AS name_a, b.name AS name_b, count(*) AS shared, round(least(0.3 + 0.1 * count(*), 0.9)::DOUBLE, 6) AS weight FROM mention a JOIN mention b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL")
def knows_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return identity.knows(_mentions(spark, folder), "doc_id").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_MENTIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM mention) SELECT x.doc_id AS a, y.doc_id AS b, x.name FROM n x JOIN n y ON x.name = y.name AND y.k BETWEEN x.k + 1 AND x.k + 4")
def co_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return identity.co_mentions(_mentions(spark, folder), key="doc_id")


@query(r"""WITH hits AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM hits GROUP BY ALL""")
def links_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_WORD = r"<title>([^\s<&]+)"


@query(rf"""WITH title AS (SELECT lower(regexp_replace(regexp_extract(html, '{_WORD}', 1), '[^\p{{L}}]', '', 'g')) AS t, min(page_id) AS dst FROM pages GROUP BY 1),
hits AS (SELECT page_id, ltrim(unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)), '/') AS link FROM pages)
SELECT DISTINCT page_id AS src, dst, link AS evidence FROM hits JOIN title ON t = replace(lower(link), '_', ' ') WHERE page_id <> dst""")
def cites_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page's title is here the first word of its title: links of these pages are words."""
    pages = table(spark, folder, "pages")
    nodes = pages.select("page_id", F.transform(html.hrefs(F.col("html")), lambda h: F.regexp_replace(h, "^/+", "")).alias("links"))
    titles = pages.select(F.regexp_replace(F.regexp_extract("html", _WORD, 1), r"[^\p{L}]", "").alias("title"), F.col("page_id").alias("ord"), "page_id")
    return edges.cites(nodes, titles, "page_id").select("src", "dst", "evidence")


def _sql_stripped(column: str) -> str:
    for tag in html.DROPPED:
        column = rf"regexp_replace({column}, '<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'gis')"
    return f"regexp_replace({column}, '<!--.*?-->', ' ', 'gs')"


def _sql_plain(column: str) -> str:
    column = f"regexp_replace({column}, '<[^>]*>', ' ', 'g')"
    for a, b in html._ENTITIES.items():
        column = f"replace({column}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, {_sql_stripped('html')} AS h FROM pages)
SELECT page_id, coalesce(nullif({_sql_plain(r"regexp_extract(h, '<h1\b[^>]*>(.*?)</h1\s*>', 1, 'is')")}, ''), nullif({_sql_plain(r"regexp_extract(h, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is')")}, '')) AS title FROM p""")
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(rf"""WITH p AS (SELECT page_id, {_sql_stripped('html')} AS h FROM pages),
b AS (SELECT page_id, {_sql_plain("unnest(regexp_extract_all(h, '<(?:p|h[1-6]|li|pre|td)" + chr(92) + "b[^>]*>(.*?)</(?:p|h[1-6]|li|pre|td)" + chr(92) + "s*>', 1, 'is'))")} AS block FROM p)
SELECT page_id, block, count(*) AS n FROM b WHERE block <> '' GROUP BY ALL""")
def html_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.explode(html.blocks(F.col("html"))).alias("block")).groupBy("page_id", "block").agg(F.count("*").alias("n"))


@query()
def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("file"), F.col("html").alias("content"))
    return html.sections(pages, deepest=True)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


@query("SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS src, turn AS dst, 0.8::DOUBLE AS weight FROM conversations) WHERE src IS NOT NULL")
def precedes_turns(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder).withColumn("node", F.struct("conv_id", "turn"))
    return edges.precedes(t, ["conv_id"], ["turn"], "node").select("dst.conv_id", F.col("src.turn").alias("src"), F.col("dst.turn").alias("dst"), "weight")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT x.conv_id, x.turn AS a, y.turn AS b, 0.4::DOUBLE AS weight FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.n BETWEEN x.n + 1 AND x.n + 3""")
def co_occurs_turns(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder).withColumn("node", F.struct("conv_id", "turn"))
    return edges.co_occurs(t, ["conv_id"], ["turn"], key="node").select("a.conv_id", F.col("a.turn").alias("a"), F.col("b.turn").alias("b"), "weight")


_SECTIONS_SQL = "sec AS (SELECT conv_id, turn, i, role, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (turn ' || (i // 2 + 1) || ')' AS title, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'))"


@query(f"WITH {_SECTIONS_SQL} SELECT conv_id, i AS sec_ord, title, text AS content FROM sec")
def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.sections(_turns(spark, folder), "conv_id", "turn", "text")


@query(f"WITH {_SECTIONS_SQL} SELECT a.conv_id, a.i AS answer, u.i AS said FROM sec a JOIN sec u ON a.conv_id = u.conv_id AND replace(a.title, 'Assistant', 'User') = u.title WHERE a.title LIKE 'Assistant%'")
def sibling_pairs(spark: SparkSession, folder: str) -> DataFrame:
    s = conversation.sections(_turns(spark, folder), "conv_id", "turn", "text").select(F.concat_ws("-", "conv_id", "sec_ord").alias("node_id"), F.col("conv_id").cast("string").alias("file"), F.col("title").alias("section"))
    # each answer is a question of its own, so that what comes with it is known
    chosen = s.where("section like 'Assistant%'").select(F.col("node_id").alias("question_id"), "node_id", F.lit(1.0).alias("score"))
    part = lambda c, k: F.split_part(F.col(c), F.lit("-"), F.lit(k)).cast("long")
    return retrieve.siblings(chosen, s).select(part("question_id", 1).alias("conv_id"), part("question_id", 2).alias("answer"), part("node_id", 2).alias("said"))


@query("""SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, sum(len(text))::BIGINT AS chars,
arg_min(CASE WHEN len(text) > 80 THEN text[1:80] || '...' ELSE text END, turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id""")
def sessions_summary_rollup(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder)
    own = t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.sum(F.length("text")).alias("chars"))
    return own.join(conversation.titles(t, "conv_id", "turn", "text"), "conv_id", "left")


@query(rf"""WITH t AS (SELECT role, unnest(string_split_regex(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS term FROM conversations),
c AS (SELECT role, term, count(*) AS n FROM t WHERE len(term) > 1 AND term NOT IN ({STOP_SQL}) GROUP BY ALL)
SELECT role, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20""")
def role_profile_topk(spark: SparkSession, folder: str) -> DataFrame:
    t = _turns(spark, folder).select("role", X.tokens_fold(F.col("text")).alias("entities"))
    out = None
    for role in [r.role for r in t.select("role").distinct().orderBy("role").collect()]:
        own = identity.user_profile(t.where(F.col("role") == role).withColumn("role", F.lit("user")), 20)
        own = own.select(F.lit(role).alias("role"), F.posexplode("counts").alias("rank", "term", "n")).select("role", "term", "n", (F.col("rank") + 1).cast("long").alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


_ROW = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("WITH r AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 10 AS batch, c_custkey, " + " || ', ' || ".join(f"'{c}: ' || coalesce(nullif({c}::VARCHAR, ''), 'N/A')" for c in _ROW) + " AS line FROM customer) SELECT batch, string_agg(line, chr(10) ORDER BY c_custkey) AS content FROM r GROUP BY batch")
def csv_row_batches(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.row_sections(table(spark, folder, "customer"), ["c_custkey"], _ROW).select("batch", "content")


@query("SELECT event_id, k AS title, (props::JSON ->> k) AS content FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("content"))
    return tabular.json_sections(docs).select(F.col("doc_id").alias("event_id"), "title", "content")
