"""Queries over sources, scalar text operators, corrections, sessions, evaluation: inputs are made of the tables' columns, and the DuckDB twins know
the answer from the columns, without the patterns that the operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embed
from ..functions import text as X
from ..operators import audit, correct, edges, identity, index, maintain, reflect, report, retrieve, summaries, traverse
from ..schema import CONFIDENCE, Graph
from ..shared import parts_of, settled, shared_folder, table
from ..sources import conversation, files, markdown, media, subtitles
from ..streaming import stream
from . import build, evaluate, prompts, questions, store
from .contract_change import _NOW, AS_OF, now
from .contract_graph import _GRAPH_SQL, _NODES_SQL, trade_graph, trade_nodes
from .contract_text import _mentions, documents
from .registry import query



def _map() -> Column:
    return F.create_map().cast("map<string,string>")


def _joined(rows: DataFrame, by: str, order: str, line: Column, mark: str) -> DataFrame:
    """by, content: lines of a group in order."""
    own = rows.select(by, order, line.alias("line")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), mark).alias("content"))
    return own.select(F.col(by).alias("doc_id"), F.concat(F.lit("f"), F.col(by)).alias("file"), "content")


def _flat(text: str = "text") -> Column:
    return F.regexp_replace(text, r"\s+", " ")


_FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"

# Sources


@query("""SELECT r_regionkey AS doc_id, 0 AS sec_ord, 1 AS depth, r_name AS title, 'All of ' || r_name AS content, NULL::BIGINT AS parent_ord FROM region
UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 2, n_name, 'Nation ' || n_nationkey || chr(10) || 'a line', 0 FROM nation""")
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    parts = _joined(table(spark, folder, "nation"), "n_regionkey", "n_nationkey", F.concat(F.lit("## "), "n_name", F.lit("\nNation "), "n_nationkey", F.lit("\na line\n")), "\n")
    docs = parts.join(table(spark, folder, "region"), F.col("doc_id") == F.col("r_regionkey")).select("doc_id", "file", F.concat(F.lit("lost\n# "), "r_name", F.lit("\nAll of "), "r_name", F.lit("\n\n"), "content").alias("content"))
    return markdown.sections(docs).select("doc_id", F.col("sec_ord").cast("long").alias("sec_ord"), "depth", "title", "content", "parent_ord")


@query("SELECT c_custkey, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("---\nnation: 99\nsegment: "), "c_mktsegment", F.lit("\nno pair\nnation:   "), "c_nationkey", F.lit(" \n---\n# Title\nkey: not one"))
    return table(spark, folder, "customer").select("c_custkey", F.explode(markdown.front_matter(text)))


@query(r"SELECT item_id AS doc_id, 'item' || item_id AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM benchmark")
def plain_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item"), "item_id").alias("file"), F.col("text").alias("content"))
    return markdown.sections(markdown.plain(docs)).select("doc_id", "title", "content")


_CHATS = ("labelled", "export", "team", "raw", "quoted")


def _chats(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The conversations as texts of each format."""
    t = table(spark, folder, "conversations").where("role != 'system'").withColumn("flat", _flat())
    json = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    lab = _joined(t, "conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), "flat"), "\n\n")
    message = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("flat").alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time")).alias("message"))
    mapping = t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(F.lit("x").alias("id"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lpad("turn", 6, "0"), message)))).alias("mapping"))).alias("content"))
    posts = _joined(t, "conv_id", "turn", json(type=F.lit("message"), text=F.col("flat"), ts=F.col("turn").cast("string"), bot_id=F.when(F.col("role") == "assistant", "B")), ",")
    plain = _joined(t.withColumn("flat", F.concat(F.lit("p. "), "flat")), "conv_id", "turn", F.col("flat"), "\n\n")
    return {
        "labelled": lab, "export": mapping.withColumn("file", F.lit("f")).select("doc_id", "file", F.concat(F.lit("["), "content", F.lit("]")).alias("content")),
        "team": posts.withColumn("content", F.concat(F.lit("["), "content", F.lit("]"))), "raw": plain, "quoted": plain.withColumn("content", F.concat(F.lit("> "), "content")),
    }


@query("SELECT k AS format, count(DISTINCT conv_id) AS n FROM conversations, (VALUES " + ", ".join(f"('{c}')" for c in _CHATS) + ") AS v(k) WHERE role <> 'system' GROUP BY k")
def chat_formats(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for docs in _chats(spark, folder).values():
        own = docs.select(conversation.format_of(F.col("content")).alias("format"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("format").agg(F.count("*").alias("n"))


_TURNS_SQL = f"SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, ROLE AS role, CONTENT AS content FROM (SELECT *, {_FLAT} AS flat FROM conversations WHERE role <> 'system')"


def _chat_query(name: str, role: str = "role", content: str = "flat") -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        read = {"labelled": conversation.labelled, "export": conversation.export, "team": conversation.team, "raw": conversation.raw}[name]
        return read(_chats(spark, folder)[name]).select("doc_id", F.col("pos").cast("long").alias("pos"), "role", "content")

    query(_TURNS_SQL.replace("ROLE", role).replace("CONTENT", content), f"chat_{name}")(run)


_chat_query("labelled", content=r"regexp_replace(flat, '\s+$', '')")
_chat_query("export")
_chat_query("team")
_chat_query("raw", "CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) % 2 = 1 THEN 'user' ELSE 'assistant' END", "trim('p. ' || flat, ' ')")


@query("SELECT conv_id AS doc_id, k AS sec_ord, 'Part ' || (k + 1) AS title, string_agg('said ' || turn || ' more', chr(10) ORDER BY turn) AS content FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10 AS k FROM conversations) GROUP BY conv_id, k")
def subtitle_parts(spark: SparkSession, folder: str) -> DataFrame:
    block = F.concat("turn", F.lit("\n00:00:01,000 --> 00:00:02,000\n<i>said "), "turn", F.lit("</i>\nmore\n"))
    return subtitles.sections(_joined(table(spark, folder, "conversations"), "conv_id", "turn", block, "\n"))


_ENDINGS = {"md": "markdown", "TXT": "markdown", "htm": "html", "csv": "csv", "json": "json", "pdf": "pdf", "srt": "subtitles", "xyz": None}


@query("SELECT doc_id, e.kind, CASE WHEN e.kind IS NULL THEN 'no reader for .xyz' END AS reason FROM (SELECT doc_id, len(text) % 8 AS k FROM documents) JOIN (VALUES " + ", ".join(f"({k}, {repr(v) if v else 'NULL'})" for k, v in enumerate(_ENDINGS.values())) + ") AS e(k, kind) USING (k)")
def file_readers(spark: SparkSession, folder: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _ENDINGS)), F.length("text") % 8 + 1)
    file = F.concat(F.lit("a.b/c"), "doc_id", F.lit("."), end)
    return table(spark, folder, "documents").select("doc_id", files.reader(file).alias("kind"), files.skipped(file, files.reader(file)).alias("reason"))


@query("SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS sec_ord, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '. Nation ' || n_name AS title, 'its key is ' || n_nationkey || '.' || chr(10) || 'and so on, it goes.' AS content FROM nation UNION ALL SELECT r_regionkey, 0, 'Content', 'a word before.' FROM region")
def page_headings(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").withColumn("page", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    pages = n.select(F.col("n_regionkey").alias("doc_id"), "page", F.concat(F.col("page"), F.lit(". Nation "), "n_name", F.lit("\nits key is "), "n_nationkey", F.lit(".\n\n and so on, it goes.")).alias("text"))
    front = table(spark, folder, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(0).alias("page"), F.lit("a word before.").alias("text"))
    return media.page_sections(pages.unionByName(front))


@query("SELECT c_nationkey AS doc_id, k AS sec_ord, 'Pages ' || (min(p) + 1) || '-' || (max(p) + 1) AS title, string_agg(c_name, chr(10) || chr(10) ORDER BY p) AS content FROM (SELECT *, p // 10 AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p FROM customer)) GROUP BY c_nationkey, k")
def page_batches(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return media.page_batches(c.select(F.col("c_nationkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("page"), F.col("c_name").alias("text")))


@query("SELECT p_partkey AS doc_id, 'img part ' || p_partkey AS title, 'The file is named img part ' || p_partkey || '. The camera was made by ' || p_brand || '. The camera is a ' || p_type || '. It has ' || p_size || ' pixels.' AS content FROM part")
def picture_sentences(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.create_map(F.lit("make"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("model"), "p_type", F.lit("lens"), F.lit(" "))
    docs = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("x/img_part-"), "p_partkey", F.lit(".jpeg")).alias("file"), meta.alias("metadata"))
    return media.media_sections(docs, media.PICTURE).select("doc_id", "title", "content")


@query("SELECT s_suppkey AS doc_id, 'The file is named f' || s_suppkey || '. The film is called ' || s_name || '. It lasts ' || s_nationkey || ' seconds.' AS content FROM supplier")
def film_sentences(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.create_map(F.lit("duration"), F.col("s_nationkey").cast("string"), F.lit("title"), "s_name")
    docs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("f"), "s_suppkey", F.lit(".mp4")).alias("file"), meta.alias("metadata"))
    return media.media_sections(docs, media.FILM).select("doc_id", "content")


@query("SELECT item_id, text FROM benchmark ORDER BY md5('7|' || item_id), item_id LIMIT 20")
def question_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling is the operator here."""
    return evaluate.sampled(table(spark, folder, "benchmark").select("item_id", "text"), "item_id", 20, 7)


@query(f"WITH {_NODES_SQL} SELECT node_id, type FROM node WHERE type <> 'part'")
def store_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions are saved, and a third is broken off before its mark: the newest complete one is read."""
    nodes = trade_nodes(spark, folder)
    d, u = (e.drop("ord") for e in trade_graph(spark, folder))
    base = f"{shared_folder(spark)}/store-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    store.save(spark, Graph(nodes, d, u, version=1), base, "trade")
    store.save(spark, Graph(nodes.where("type != 'part'"), d, u, version=2), base, "trade")
    nodes.limit(0).write.parquet(f"{base}/trade/v0000000003/nodes")
    return store.tables(spark, base, store.found(spark, base, "trade"))["nodes"]


# Scalar operators over texts that are made of columns


@query(r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS pos, p AS paragraph FROM (SELECT doc_id, i, trim(p, ' ') AS p FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\n\n+') AS ps FROM documents))) WHERE p <> ''")
def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.posexplode(X.paragraphs(F.col("content"))).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


@query(r"SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::BIGINT AS pos, p AS chunk FROM (SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ps FROM conversations)) WHERE len(trim(p, ' ')) >= 20")
def chunks_least(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as paragraphs; those of fewer than 20 characters go."""
    t = table(spark, folder, "conversations")
    made = X.chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 10_000)
    return t.select("conv_id", "turn", F.posexplode(made).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, 0::BIGINT AS pos, url AS link FROM pages UNION ALL SELECT page_id, 1, 'Page ' || page_id FROM pages")
def markdown_links(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("see [[Page "), "page_id", F.lit("]] and [this]("), "url", F.lit(") but [not ] (x)"))
    return table(spark, folder, "pages").select("page_id", F.posexplode(X.links(text)).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long"))


_CODES = "list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)"


@query(f"SELECT c_name, CASE WHEN h >= 2147483648 THEN '-' ELSE '' END || lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS hash FROM (SELECT c_name, list_reduce(list_prepend(5381::BIGINT, {_CODES}), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM customer)")
def hash_multiplicative(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_name", X.compatible_hash(F.col("c_name")).alias("hash"))


@query(f"SELECT c_name, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, {_CODES}), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS token FROM customer")
def names_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_name", X.redacted(F.col("c_name")).alias("token"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_name END AS term FROM part")
def defined_terms(spark: SparkSession, folder: str) -> DataFrame:
    verb = F.element_at(F.array(*map(F.lit, (" is a thing of iron.", " refers to things.", " was there."))), F.col("p_size") % 3 + 1)
    return table(spark, folder, "part").select("p_partkey", X.defined_term(F.concat(F.lit("The "), "p_name", verb)).alias("term"))


@query("SELECT doc_id, CASE WHEN k = 0 THEN 'definition' WHEN k IN (1, 2) THEN 'event' WHEN k = 3 THEN 'preference' ELSE 'fact' END AS kind FROM (SELECT doc_id, len(text) % 5 AS k FROM documents)")
def correction_kinds(spark: SparkSession, folder: str) -> DataFrame:
    said = ("A gear is a wheel", "It was founded here", "in 1999 it rained", "You should rest", "Rain falls")
    text = F.element_at(F.array(*map(F.lit, said)), F.length("text") % 5 + 1)
    return table(spark, folder, "documents").select("doc_id", X.correction_kind(text).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_custkey % 4 = 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d (%a)') END AS date FROM orders")
def dates_normal(spark: SparkSession, folder: str) -> DataFrame:
    form = lambda f: F.date_format("o_orderdate", f)
    text = F.element_at(F.array(form("yyyy/MM/dd (EEE)"), form("yyyy/MM/dd"), form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("soon")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", X.normal_date(text).alias("date"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 12 END::DOUBLE AS n FROM part")
def numbers_found(spark: SparkSession, folder: str) -> DataFrame:
    text = F.element_at(F.array(F.concat(F.lit("x9 about "), "p_size", F.lit(" of ten")), F.lit("Some Twelve often or thirty"), F.lit("none of x2y")), F.col("p_size") % 3 + 1)
    return table(spark, folder, "part").select("p_partkey", X.number(text).alias("n"))


@query("SELECT o_orderkey, 'order-no-' || o_orderkey || '-p' AS slug, CASE WHEN year(o_orderdate) BETWEEN 1000 AND 2029 THEN year(o_orderdate) END::INTEGER AS year FROM orders")
def slugs_and_years(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", X.slug(F.concat(F.lit("--Order No. "), "o_orderkey", F.lit(" P!"))).alias("slug"), X.year(F.concat(F.lit("x 12345 in "), F.year("o_orderdate"), F.lit(", or 1999."))).alias("year"))


_LETTERS = "translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij')"


def _people(spark: SparkSession, folder: str) -> DataFrame:
    """A customer as a node that tells of a person, of their place and role."""
    name = F.concat(F.lit("Ana K"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    role = F.element_at(F.array(F.lit("engineer"), F.lit("teacher"), F.lit("gardener")), F.col("c_nationkey") % 3 + 1)
    content = F.concat(F.lit("In town "), name, F.lit(" works for "), "c_mktsegment", F.lit(" as a "), role, F.lit(". And so on."))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("ord"), content.alias("content"), F.array(name).alias("entities"), F.concat(F.lit("n"), "c_nationkey").alias("file"), "c_acctbal", "c_nationkey", "c_mktsegment")


@query(f"SELECT 'Ana K' || {_LETTERS} AS name, CASE c_nationkey % 3 WHEN 0 THEN 'engineer' WHEN 1 THEN 'teacher' END AS role, c_mktsegment AS organisation FROM customer")
def person_attributes(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder)
    return identity.attributes(identity.mentions(people), people)


@query(f"SELECT 'Ana K' || {_LETTERS} AS content, 'person' AS type, 0.6::DOUBLE AS confidence, '1' AS mentions FROM customer")
def person_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return build.person_nodes(identity.mentions(_people(spark, folder)), now()).select("content", "type", "confidence", F.element_at("metadata", "mentions").alias("mentions"))


@query(r"WITH mention AS (SELECT DISTINCT doc_id, regexp_replace(e, '\s+', ' ', 'g') AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(\p{Lu}\p{Ll}+(?:[\s\-]\p{Lu}\p{Ll}+)+)', 1)) AS e FROM documents) WHERE regexp_full_match(e, '\p{Lu}\p{Ll}+(\s+\p{Lu}\p{Ll}+)+')) SELECT doc_id AS src, name, 0.6::DOUBLE AS weight FROM mention")
def discussed_in(spark: SparkSession, folder: str) -> DataFrame:
    return identity.discussed_in(_mentions(spark, folder), "doc_id").select("src", "name", "weight")


@query("SELECT entity, n, row_number() OVER (ORDER BY n DESC, entity) <= 10 AS domain FROM (SELECT c_mktsegment || (c_nationkey // 5) AS entity, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, entity LIMIT 20)")
def user_profile(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.when(F.col("c_acctbal") > 0, "user").otherwise("assistant").alias("role"), F.array(F.concat("c_mktsegment", F.floor(F.col("c_nationkey") / 5))).alias("entities"))
    return identity.user_profile(c).select("domains", F.explode("counts").alias("entity", "n")).select("entity", "n", F.array_contains("domains", F.col("entity")).alias("domain"))


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS term FROM benchmark) WHERE term <> '' GROUP BY term")
def tokens_custom(spark: SparkSession, folder: str) -> DataFrame:
    """An analyzer of one's own: words between blanks, whatever they are."""
    nodes = table(spark, folder, "benchmark").select(F.col("item_id").alias("node_id"), F.col("text").alias("content"))
    own = index.postings(nodes, lambda t: F.filter(F.split(F.lower(t), " "), lambda w: w != ""))
    return own.groupBy("term").agg(F.count("*").alias("df"))


# Extractors over notes that hold one of each

_ISO, _DAY = "strftime(o_orderdate, '%Y-%m-%d')", "(day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate))"
_NOTE_FINDS = {
    "iso_dates": [_ISO], "backticks": ["'val_' || o_custkey"], "camel": ["'orderKey'"], "urls": ["'https://shop.example.org/o/' || o_orderkey"], "tags": ["'#tag' || o_orderkey", "'@user_' || o_custkey"],
    "money": ["'$' || o_custkey || '.50'", "o_custkey || ' EUR'"], "cjk": ["'日本語'"], "katakana": ["'カタカナ'"], "hangul": ["'한국어'"], "indic": ["'हिन्दी'"], "arabic": ["'العربية'"], "hebrew": ["'עברית'"], "thai": ["'ภาษาไทย'"], "georgian": ["'ქართული'"],
    "ethiopic": ["'አማርኛ'"], "myanmar": ["'မြန်မာ'"], "khmer": ["'ខ្មែរ'"], "tibetan": ["'བོད་ཡིག'"], "sinhala": ["'සිංහල'"], "parenthesised": ["'or so ' || o_custkey"], "measures": ["(o_custkey + 1) || ' km'"], "day_dates": [_DAY], "emails": ["'a.b' || o_custkey || '@mail.example.org'"],
}


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    parts = [
        F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or "), F.concat_ws(".", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")), F.lit(" the `val_"), c, F.lit("` of orderKey (see https://shop.example.org/o/"), k, F.lit(" ) for $"), c,
        F.lit(".50 and "), c, F.lit(" EUR, "), F.col("o_custkey") + 1, F.lit(" km away #tag"), k, F.lit(" by @user_"), c, F.lit(" (or so "), c, F.lit(") mail a.b"), c, F.lit("@mail.example.org : 日本語 カタカナ 한국어 हिन्दी العربية עברית ภาษาไทย ქართული አማርኛ မြန်မာ ខ្មែរ བོད་ཡིག සිංහල"),
    ]
    return o.select("o_orderkey", F.concat(*parts).alias("content"))


def _note_query(name: str, finds: list[str]) -> None:
    where = {"parenthesised": " UNION ALL SELECT o_orderkey, 'see https://shop.example.org/o/' || o_orderkey || ' ' FROM orders"}.get(name, "")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _notes(spark, folder).select("o_orderkey", F.explode(X.EXTRACTORS[name](F.col("content"))).alias("entity"))

    query(" UNION ALL ".join(f"SELECT o_orderkey, {f} AS entity FROM orders" for f in finds) + where, f"notes_{name}")(run)


for _name, _finds in _NOTE_FINDS.items():
    _note_query(_name, _finds)

# Nodes and edges

_LITTLE = "SELECT item_id, 'item' || item_id AS file, text FROM benchmark"


@query(rf"WITH d AS ({_LITTLE}) SELECT file, 0::BIGINT AS at, 'document' AS type, file AS content FROM d UNION ALL SELECT file, 1, 'section', file FROM d UNION ALL SELECT file, 2, {X.kind_sql('t')}, t FROM (SELECT file, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM d)")
def nodes_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each item is a document of one section of one chunk."""
    nodes = build.chunk_nodes(build.numbered(_little(spark, folder)), now())
    at = F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1
    return nodes.select("file", at.cast("long").alias("at"), "type", "content")


def _little(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item"), "item_id").alias("file"), F.replace("text", F.lit("\n\n"), F.lit("\n")).alias("content"))
    s = markdown.sections(markdown.plain(docs))
    return s.select("file", F.col("doc_id").alias("doc_ord"), F.col("file").alias("doc_title"), "sec_ord", "title", "content", _map().alias("metadata"))


@query("SELECT 'item' || item_id AS file, 'document' AS outer, 'section' AS inner FROM benchmark UNION ALL SELECT 'item' || item_id, 'section', 'chunk' FROM benchmark")
def contains_tree(spark: SparkSession, folder: str) -> DataFrame:
    nodes = settled(build.chunk_nodes(build.numbered(_little(spark, folder)), now()))
    own = build.directed_edges(nodes, contains=True).where("type = 'contains'")
    kind = lambda k: nodes.select(F.col("node_id").alias(k), F.when(F.col("type").isin("document", "section"), F.col("type")).otherwise("chunk").alias(f"{k}_type"), F.col("file").alias(f"{k}_file"))
    return own.join(kind("src"), "src").join(kind("dst"), "dst").where("src_file = dst_file").select(F.col("src_file").alias("file"), F.col("src_type").alias("outer"), F.col("dst_type").alias("inner"))


@query("SELECT doc_ord, file, (row_number() OVER (ORDER BY doc_ord, file) - 1 + 100)::BIGINT AS doc_no FROM (SELECT DISTINCT doc_id AS doc_ord, source AS file FROM documents)")
def documents_numbered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("source").alias("file"), "lang")
    return build.numbered(rows.unionByName(rows), 100).select("doc_ord", "file", "doc_no").distinct()


# Retrieval


@query("SELECT lang AS question_id, doc_id AS node_id, max(s) AS score FROM (SELECT lang, doc_id, n_chars::DOUBLE AS s FROM documents UNION ALL SELECT lang, doc_id, 5000 - n_chars FROM documents WHERE n_chars < 5000) GROUP BY ALL")
def seed_merge(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("lang").alias("question_id"), F.col("doc_id").alias("node_id"), F.col("n_chars").cast("double").alias("score"))
    return retrieve.merged(d, d.where("score < 5000").withColumn("score", 5000 - F.col("score")))


@query("SELECT lang AS question_id, doc_id AS node_id, round(n_chars * CASE WHEN source = 'src1' AND lang = 'en' THEN 1.3 ELSE 1 END, 6)::DOUBLE AS score FROM documents WHERE NOT (source = 'src1' AND lang = 'de')")
def summary_policy(spark: SparkSession, folder: str) -> DataFrame:
    """A source as summaries: English questions prefer them, German ones leave them out, others take them as they are."""
    d = table(spark, folder, "documents")
    scores = d.select(F.col("lang").alias("question_id"), F.col("doc_id").alias("node_id"), F.col("n_chars").cast("double").alias("score"), F.when(F.col("lang") == "en", True).when(F.col("lang") == "de", False).alias("prefer"))
    types = d.select(F.col("doc_id").alias("node_id"), F.when(F.col("source") == "src1", retrieve.SUMMARY).otherwise("fact").alias("type"))
    return retrieve.with_summaries(scores, types, F.col("prefer")).select("question_id", "node_id", F.round("score", 6).alias("score"))


@query("SELECT r_name AS question_id, 'c' || c_custkey AS node_id, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE c_acctbal * 0.5 END AS score FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT min(s_suppkey) AS s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) ON s_nationkey = c_nationkey UNION ALL SELECT r_name, 'n' || s_nationkey, 1.0 FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 3000) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def summary_children(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as summaries of their customers, there only if they have a rich supplier."""
    t = lambda n: table(spark, folder, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("question_id"))
    people = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("question_id", F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_acctbal").alias("score"))
    rich = t("supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(place, "n_nationkey").select("question_id", F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.lit(1.0).alias("score"))
    d = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("summarizes").alias("type"))
    return retrieve.without_repetition(people.unionByName(rich), d).select("question_id", "node_id", "score")


@query("""WITH s AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS who, i // 2 AS k, len(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'))
SELECT 'q' AS question_id, u.conv_id || '-' || u.i AS node_id, (max(a.n) * 0.9)::DOUBLE AS score FROM s a JOIN s u ON a.conv_id = u.conv_id AND a.k = u.k AND u.who = 'User' WHERE a.who = 'Assistant' AND a.n > 100 GROUP BY ALL""")
def sibling_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Long answers are chosen; what was asked comes with them."""
    s = conversation.sections(table(spark, folder, "conversations"), "conv_id", "turn", "text")
    nodes = s.select(F.concat_ws("-", "conv_id", "sec_ord").alias("node_id"), F.col("conv_id").cast("string").alias("file"), F.col("title").alias("section"), "content")
    chosen = nodes.where("section like 'Assistant%' and length(content) > 100").select(F.lit("q").alias("question_id"), "node_id", F.length("content").cast("double").alias("score"))
    return retrieve.siblings(chosen, nodes)


_PLAN = {k: s for k, s in questions.STRATEGIES.items()}


@query(f"SELECT question, kind, CASE kind {' '.join(f'''WHEN '{k}' THEN '{prompts.HINTS[k].replace(chr(39), chr(39) * 2)}' ''' for k in questions.KINDS)} END AS hint FROM (SELECT text AS question, {questions.kind_sql('text')} AS kind FROM conversations)")
def prompt_hints(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "conversations").select(F.col("text").alias("question")).withColumn("kind", questions.kind(F.col("question")))
    return q.withColumn("hint", prompts.category(F.col("kind")))


@query(rf"""SELECT item_id, '{prompts.GENERAL}' || chr(10) || chr(10) || 'Today is 2024-07-01.' || chr(10) || chr(10) || CASE WHEN len(text) > 150 THEN '{prompts.HINTS[questions.KINDS[2]]}' || chr(10) || chr(10) ELSE '' END
|| CASE WHEN len(text) > 200 THEN '--- PREFERENCES ---' || chr(10) || '- tea' || chr(10) || '- rain' || chr(10) || chr(10) ELSE '' END || 'F' || item_id || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark""")
def prompt_texts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.length("text") > 150, questions.KINDS[2]).otherwise(questions.KINDS[5])
    liked = prompts.preference_block(F.when(F.length("text") > 200, F.array(F.lit("tea"), F.lit("rain"))))
    text = prompts.prompt(F.concat(F.lit("F"), "item_id"), F.col("text"), kind, F.lit("2024-07-01"), liked, F.lit(None).cast("string"), F.lit(False))
    return table(spark, folder, "benchmark").select("item_id", text.alias("prompt"))


@query("SELECT lang AS question_id, '--- INSIGHTS ---' || chr(10) || string_agg('- [n' || rank || '] about ' || doc_id, chr(10) ORDER BY rank) AS insights FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE n_chars >= 100 AND source = 'src1' GROUP BY lang")
def insight_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    meta = F.when(F.col("source") == "src1", F.create_map(F.lit("synthesis"), F.concat(F.lit("about "), "doc_id"))).otherwise(_map())
    return retrieve.insights(d.select(F.col("lang").alias("question_id"), "rank", (F.col("n_chars") / 1000).alias("score"), meta.alias("metadata")))


@query(f"WITH {_GRAPH_SQL}, {_NODES_SQL} SELECT 'edge' AS of, src AS a, dst AS b, type, weight FROM dedge UNION ALL SELECT 'edge', a, b, type, weight FROM uedge UNION ALL SELECT 'node', node_id, CASE WHEN len(node_id || ' of the table of all ' || type) > 30 THEN (node_id || ' of the table of all ' || type)[1:30] || '...' ELSE node_id || ' of the table of all ' || type END, type, NULL FROM node")
def graph_view(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    e = retrieve.edge_view(d, u).select(F.lit("edge").alias("of"), F.col("source").alias("a"), F.col("target").alias("b"), "type", "weight")
    nodes = trade_nodes(spark, folder).withColumn("content", F.concat("node_id", F.lit(" of the table of all "), "type"))
    return e.unionByName(retrieve.labels(nodes, 30).select(F.lit("node").alias("of"), F.col("node_id").alias("a"), F.col("label").alias("b"), "type", F.lit(None).cast("double").alias("weight")))


@query("SELECT 'v' || vec_id AS node_id, CASE WHEN label = 0 THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS vec FROM embeddings")
def embed_static(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of one label have no vector of their own, and so zeros."""
    v = table(spark, folder, "embeddings").withColumn("text", F.concat(F.lit("v"), "vec_id"))
    e = embed.static(v.where("label != 0").select("text", F.col("embedding").alias("vec")), 64, on_miss="zeros")
    return e(v.select(F.col("text").alias("node_id"), F.col("text").alias("content")))


@query("SELECT item_id AS node_id, [len(text)::DOUBLE, len(string_split(text, ' '))::DOUBLE] AS vec FROM benchmark")
def embed_batched(spark: SparkSession, folder: str) -> DataFrame:
    e = embed.batched(lambda texts: [[float(len(t)), float(t.count(" ") + 1)] for t in texts], 2, "lengths", batch=7)
    return e(table(spark, folder, "benchmark").select(F.col("item_id").alias("node_id"), F.col("text").alias("content")))


# Changes


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as nodes."""
    n = table(spark, folder, "nation")
    return n.select(
        F.col("n_nationkey").alias("node_id"), F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("r"), "n_regionkey").alias("file"), F.concat(F.lit("Nation "), "n_name", F.lit(" trades by the sea.")).alias("content"), F.md5("n_name").alias("content_hash"), F.array("n_name").alias("entities"),
        F.lit(CONFIDENCE).alias("confidence"), F.when(F.col("n_regionkey") == 1, F.lit("2020-01-01").cast("timestamp")).alias("valid_until"), _map().alias("metadata"), F.lit("fact").alias("type"), F.lit(AS_OF).cast("timestamp").alias("created_at"), "n_regionkey", "n_name",
    )


@query("SELECT n_nationkey AS node_id, CASE WHEN n_regionkey = 2 THEN 'New ' || n_name ELSE 'Nation ' || n_name || ' trades by the sea.' END AS content, CASE WHEN n_regionkey = 2 THEN sha256('New ' || n_name) ELSE md5(n_name) END AS content_hash, CASE WHEN n_regionkey = 2 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM nation")
def edit_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = _nations(spark, folder)
    edits = n.where("n_regionkey = 2").select("node_id", F.concat(F.lit("New "), "n_name").alias("new_content"))
    return maintain.edited(n, edits).select("node_id", "content", "content_hash", "confidence")


@query(f"SELECT n_nationkey AS node_id, CASE WHEN n_regionkey = 3 THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN n_regionkey = 3 THEN {_NOW} WHEN n_regionkey = 1 THEN TIMESTAMP '2020-01-01' END AS valid_until, CASE WHEN n_regionkey = 3 THEN 'user: asked' END AS reason FROM nation")
def soft_delete(spark: SparkSession, folder: str) -> DataFrame:
    out = maintain.expired(_nations(spark, folder), F.col("n_regionkey") == 3, now(), "user: asked")
    return out.select("node_id", "confidence", "valid_until", F.element_at("metadata", "delete_reason").alias("reason"))


_NODE_COLUMNS = ["node_id", "type", "file", "content", "confidence", "metadata"]


@query("SELECT 'node' AS of, 'Nation ' || n_name || ' must export.' AS what, 'preference' AS type, 1.0::DOUBLE AS weight, 'heard' AS reason FROM nation UNION ALL SELECT 'edge', n_nationkey::VARCHAR, 'supports', 0.9, 'correction: heard' FROM nation WHERE n_regionkey < 2")
def add_facts(spark: SparkSession, folder: str) -> DataFrame:
    more = _nations(spark, folder).select(F.concat(F.lit("Nation "), "n_name", F.lit(" must export.")).alias("content"), F.lit("heard").alias("reason"), F.when(F.col("n_regionkey") < 2, F.col("node_id").cast("string")).alias("node_id"))
    nodes, made = correct.added(more.unionByName(more), now(), _NODE_COLUMNS, 0)
    out = nodes.select(F.lit("node").alias("of"), F.col("content").alias("what"), "type", F.col("confidence").alias("weight"), F.element_at("metadata", "reason").alias("reason"))
    return out.unionByName(made.select(F.lit("edge").alias("of"), F.col("src").alias("what"), "type", "weight", F.col("evidence").alias("reason")))


@query("SELECT o_orderkey, CASE WHEN k = 4 THEN 'unknown kind' WHEN k <> 2 AND o_totalprice < 50000 THEN 'no content' WHEN k <> 1 AND o_custkey < 10 THEN 'no node' WHEN o_custkey >= 1000 THEN 'unknown node' END AS error FROM (SELECT *, o_orderkey % 5 AS k FROM orders)")
def corrections_checked(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (*correct.KINDS, "burn"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", kind.alias("kind"), F.when(F.col("o_custkey") >= 10, F.col("o_custkey").cast("string")).alias("node_id"), F.when(F.col("o_totalprice") < 50000, " ").otherwise("text").alias("content"))
    nodes = table(spark, folder, "orders").where("o_custkey < 1000").select(F.col("o_custkey").cast("string").alias("node_id")).distinct()
    return correct.checked(rows, nodes).select("o_orderkey", "error")


@query(r"SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS content, 'Imported from: desk' AS reason FROM benchmark")
def import_corrections(spark: SparkSession, folder: str) -> DataFrame:
    chunks = build.chunk_nodes(_little(spark, folder), now())
    return correct.from_chunks(chunks, "desk").select("content", "reason")


@query("SELECT n_nationkey AS new_id, n_nationkey AS old_id, 2::BIGINT AS shared FROM nation")
def append_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pad = " and so the paper of the harbour told its readers last autumn in a long report"
    make = lambda said: n.select(F.col("n_nationkey").alias("node_id"), F.lit("fact").alias("type"), F.concat("n_name", F.lit(said), "r_name", F.lit(pad)).alias("content"), F.array("n_name", F.concat(F.lit("REGION "), "r_name")).alias("entities"))
    fresh, old = make(" is no longer in ").withColumn("node_id", F.col("node_id") + 1000), make(" lies in ")
    return reflect.new_contradictions(fresh, old).select((F.col("new_id") - 1000).alias("new_id"), "old_id", "shared")


@query("SELECT n_nationkey * 2 AS a, n_nationkey * 2 + 1 AS b, 2::BIGINT AS shared FROM nation")
def contradictions_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Of each nation two texts that name the same and share no word; one denies something."""
    n = table(spark, folder, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "n_name")
    said = F.when(F.col("k") == 0, "Farmers grow wheat olives barley grapes along quiet coasts, selling surplus grain every harvest season abroad").otherwise("Officials wrote elsewhere: reclassified bodies belong somewhere new; nobody minds these changes very much anyhow today")
    tag = F.array(F.concat(F.lit("Land "), "n_name"), F.concat(F.lit("Port "), "n_name"))
    nodes = n.select((F.col("n_nationkey") * 2 + F.col("k")).alias("node_id"), (F.col("n_nationkey") * 2 + F.col("k")).alias("ord"), said.alias("content"), tag.alias("entities"))
    words = settled(index.postings(nodes))
    return reflect.contradictions(nodes, index.weights(words, index.idf(words, index.count_of(nodes)))).select("a", "b", F.col("shared").cast("long").alias("shared"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN event_type = 'view' THEN TIMESTAMP '2023-01-01' WHEN ts < TIMESTAMP '2024-01-02' THEN " + _NOW + " END AS valid_until FROM events")
def stream_retention(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "ts", F.lit(CONFIDENCE).alias("confidence"), F.when(F.col("event_type") == "view", F.lit("2023-01-01").cast("timestamp")).alias("valid_until"))
    return stream.retained(e, "ts", "2024-01-02", AS_OF).select("event_id", "confidence", "valid_until")


# Sessions, enrichment, caches

_LONG = "list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: len(w) > 9)"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    long = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 9)
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text", long.alias("entities"))


@query(f"""WITH t AS (SELECT conv_id AS session, turn, role, text FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS k FROM t WHERE role = 'user' AND trim(text, ' ') <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS k FROM t WHERE trim(text, ' ') <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, w) AS k FROM (SELECT conv_id AS session, w, count(*) AS n FROM (SELECT conv_id, unnest({_LONG}) AS w FROM conversations) GROUP BY conv_id, w)),
c AS (SELECT session, string_agg(text[1:160], ' ' ORDER BY k) FILTER (k <= 3) AS c, string_agg(text[1:200], ' || ' ORDER BY k) FILTER (k <= 10) AS claims FROM u GROUP BY session),
g AS (SELECT session, string_agg(w, ',' ORDER BY k) AS es FROM e WHERE k <= 20 GROUP BY session)
SELECT s.session, coalesce(c, f.text[1:160], '') AS content, coalesce(es, '') AS entities, coalesce(claims, '') AS claims, s.turns
FROM (SELECT session, count(*) AS turns FROM t GROUP BY session) s LEFT JOIN c USING (session) LEFT JOIN g USING (session) LEFT JOIN f ON f.session = s.session AND f.k = 1""")
def session_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.session_summaries(_turns(spark, folder)).withColumn("entities", F.array_join("entities", ","))


@query("SELECT conv_id AS session, turn AS dst, 0.7::DOUBLE AS weight FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE trim(text, ' ') <> '')")
def summarizes_edges(spark: SparkSession, folder: str) -> DataFrame:
    t = settled(_turns(spark, folder))
    sessions = t.select("session").distinct().select("session", F.lit("f").alias("file"), F.col("session").alias("number"))
    nodes, made = summaries.summary_nodes(summaries.session_summaries(t), sessions, t.select("session", F.col("pos").alias("node_id"), F.col("pos").alias("ord")), now(), [*_NODE_COLUMNS, "level", "entities", "section", "ord"], 0)
    return made.join(nodes.select(F.col("node_id").alias("src"), F.element_at("metadata", "sessionId").cast("long").alias("session")), "src").select("session", "dst", "weight")


@query("SELECT c_nationkey AS session, c_custkey AS pos, 'I like ' || c_mktsegment || '.' AS statement, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal > 0) WHERE k <= 3")
def preferences_stated(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    turns = c.select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("pos"), F.when(F.col("c_acctbal") > 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("It rains. I like "), "c_mktsegment", F.lit(". So there.")).alias("text"))
    return summaries.preferences(turns).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT n_nationkey AS node_id, CASE WHEN n_regionkey < 3 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN n_regionkey < 3 THEN 'About ' || n_name END AS synthesis, CASE WHEN n_regionkey < 3 THEN 'a, b' END AS tags FROM nation")
def enrich_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = _nations(spark, folder)
    body = F.concat(F.lit('Sure! {"synthesis": "About '), "n_name", F.lit('", "tags": ["a", "b"]} Bye.'))
    replies = n.select("node_id", F.when(F.col("n_regionkey") < 3, body).when(F.col("n_regionkey") == 3, '{"synthesis": " "}').otherwise("no idea").alias("reply"))
    m = summaries.enriched(n, replies)
    return m.select("node_id", F.round("confidence", 6).alias("confidence"), F.element_at("metadata", "synthesis").alias("synthesis"), F.element_at("metadata", "tags").alias("tags"))


@query("SELECT event_id, 'said ' || event_type AS value FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT NULL, 'asked ' || event_type FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type")
def answers_cached(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type", summaries.cache_key("kind", F.col("event_type")).alias("key"))
    cache = e.where("event_type in ('view', 'click')").select("key", F.concat(F.lit("said "), "event_type").alias("value"))
    known, missing = summaries.cached(e, cache)
    return known.select("event_id", "value").unionByName(missing.select(F.lit(None).cast("long").alias("event_id"), F.concat(F.lit("asked "), "event_type").alias("value")))


# Audit


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as nodes that mention their nation, their segment and a person each."""
    p = _people(spark, folder)
    meta = F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("delete_reason"), F.lit("preview: no"))).otherwise(_map())
    return p.select("node_id", "ord", "file", "content", F.concat("entities", F.array(F.concat(F.lit("Nation"), "c_nationkey"), "c_mktsegment")).alias("entities"), F.lit("fact").alias("type"), meta.alias("metadata"), F.lit(AS_OF).cast("timestamp").alias("created_at"), F.timestamp_seconds(F.col("node_id")).alias("last_accessed_at"), (F.col("node_id") % 3).alias("access_count"), F.round(F.least(F.greatest(F.col("c_acctbal") / 5000, F.lit(0.0)), F.lit(1.0)), 2).alias("confidence"))


_SPREAD_SQL = f"""spread AS (SELECT c_custkey AS node_id, 'n' || c_nationkey AS file, ['Ana K' || {_LETTERS}, 'Nation' || c_nationkey, c_mktsegment] AS es, c_custkey % 3 AS access_count, round(least(greatest(c_acctbal / 5000, 0), 1), 2) AS confidence, c_acctbal FROM customer)"""


@query(f"""WITH {_SPREAD_SQL}, m AS (SELECT *, unnest(es) AS entity FROM spread WHERE c_acctbal >= 0)
SELECT entity, mentions, sources, accesses, confidence, CASE WHEN confidence > 0.9 THEN 'rising' WHEN confidence < 0.5 THEN 'decaying' ELSE 'stable' END AS trend FROM (SELECT entity, count(*) AS mentions, count(DISTINCT file) AS sources, sum(access_count)::BIGINT AS accesses, round(avg(confidence), 6) AS confidence FROM m GROUP BY entity HAVING count(*) >= 3 ORDER BY mentions DESC, entity LIMIT 20)""")
def entity_traces(spark: SparkSession, folder: str) -> DataFrame:
    """What was deleted for a preview is hidden."""
    return audit.traces(audit.visible(_spread(spark, folder)), most=20).select("entity", "mentions", "sources", "accesses", "confidence", "trend")


@query(f"""WITH {_SPREAD_SQL}, top AS (SELECT 'Nation' || n_nationkey AS entity FROM nation) SELECT entity, es[1] AS person, 1::BIGINT AS shared, k AS rank FROM (SELECT es[2] AS entity, es, row_number() OVER (PARTITION BY es[2] ORDER BY es[1]) AS k FROM spread) WHERE k <= 10""")
def entity_persons(spark: SparkSession, folder: str) -> DataFrame:
    top = table(spark, folder, "nation").select(F.concat(F.lit("Nation"), "n_nationkey").alias("entity"))
    return audit.related_persons(_spread(spark, folder), top).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH first AS (SELECT 'Nation' || c_nationkey AS entity, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5),
w AS (SELECT entity, c_custkey AS node, o_orderkey + 1000000 AS other, 'bought' AS type, round(o_totalprice / 1000000, 6) AS weight, 'out' AS direction FROM first JOIN orders ON o_custkey = c_custkey)
SELECT entity, other, 'order ' || (other - 1000000) AS target, type, weight, direction, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, type, direction, other) AS rank FROM w QUALIFY rank <= 10""")
def entity_relationships(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("other", F.col("o_orderkey") + 1_000_000)
    nodes = _spread(spark, folder).select("node_id", "ord", "content", "entities").unionByName(o.select(F.col("other").alias("node_id"), F.col("other").alias("ord"), F.concat(F.lit("order "), "o_orderkey").alias("content"), F.array().cast("array<string>").alias("entities")))
    d = o.select(F.col("o_custkey").alias("src"), F.col("other").alias("dst"), F.lit("bought").alias("type"), F.round(F.col("o_totalprice") / 1_000_000, 6).alias("weight"))
    top = table(spark, folder, "nation").select(F.concat(F.lit("Nation"), "n_nationkey").alias("entity"))
    none = d.limit(0).select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "weight")
    return audit.relationships(nodes, d, none, top).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SPREAD_SQL}, c AS (SELECT entity, count(*) AS mentions FROM (SELECT unnest(es) AS entity FROM spread) GROUP BY entity)
SELECT entity AS topic, trim(regexp_replace(lower(entity), '[^a-z0-9]+', '-', 'g'), '-') AS slug, mentions, row_number() OVER (ORDER BY mentions DESC, entity) AS rank FROM c QUALIFY rank <= 30""")
def topic_index(spark: SparkSession, folder: str) -> DataFrame:
    return audit.topics(_spread(spark, folder)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_GRAPH_SQL}, e AS (SELECT src, dst, type, weight FROM dedge UNION ALL SELECT a, b, type, weight FROM uedge), h AS (SELECT DISTINCT * FROM e WHERE src LIKE 's%' OR dst LIKE 's%')
SELECT 'node ' || src AS source, type, 'node ' || dst AS target, row_number() OVER (ORDER BY weight DESC, type, src, dst) AS rank FROM h QUALIFY rank <= 15""")
def topic_relationships(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    nodes = trade_nodes(spark, folder).withColumn("content", F.concat(F.lit("node "), "node_id"))
    return audit.topic_relationships(nodes, d, u, nodes.where("type = 'supplier'")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_GRAPH_SQL}, {_NODES_SQL}, deg AS (SELECT e, count(*) AS d FROM (SELECT src AS e FROM dedge UNION ALL SELECT dst FROM dedge UNION ALL SELECT a FROM uedge UNION ALL SELECT b FROM uedge) GROUP BY e),
n AS (SELECT node_id, type, coalesce(d, 0) AS d, row_number() OVER (PARTITION BY type ORDER BY node_id) AS k FROM node LEFT JOIN deg ON e = node_id)
SELECT type, count(*) AS n, round(avg(d), 6) AS degree, string_agg(node_id, ' | ' ORDER BY k) FILTER (k <= 3) AS sample FROM n GROUP BY type""")
def graph_inspected(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    nodes = trade_nodes(spark, folder).withColumns({"content": F.col("node_id"), "ord": F.lit(0)})
    return audit.inspected(nodes, d, u)


@query(f"""WITH {_GRAPH_SQL}, {_NODES_SQL}, deg AS (SELECT e, count(*) AS d FROM (SELECT src AS e FROM dedge UNION ALL SELECT dst FROM dedge UNION ALL SELECT a FROM uedge UNION ALL SELECT b FROM uedge) GROUP BY e)
SELECT node_id, round(0.9::DOUBLE * (1 + 0.1::DOUBLE * len(node_id)) * (1 + 0.05::DOUBLE * coalesce(d, 0)), 9) AS priority FROM node LEFT JOIN deg ON e = node_id WHERE type <> 'part' ORDER BY priority DESC, node_id LIMIT 50""")
def enrichment_order(spark: SparkSession, folder: str) -> DataFrame:
    d, u = trade_graph(spark, folder)
    nodes = trade_nodes(spark, folder).where("type != 'part'").withColumns({"ord": F.col("node_id"), "confidence": F.lit(CONFIDENCE), "access_count": F.length("node_id")})
    return report.enrichment_candidates(nodes, d, u).select("node_id", "priority")


@query(f"WITH {_SPREAD_SQL}, c AS (SELECT entity, count(*) AS n FROM (SELECT unnest(es) AS entity FROM spread) GROUP BY entity) SELECT entity FROM c WHERE n = 1")
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return report.coverage_gaps(_spread(spark, folder), None)


# Evaluation

_RESULTS_SQL = "r AS (SELECT o_orderkey AS question_id, o_orderstatus AS type, o_custkey % 7 > 2 AS correct, o_custkey % 3 > 0 AS routed, o_custkey % 5 > 0 AS retrieved, o_custkey % 4 AS expected, o_custkey % 6 AS answered FROM orders)"


def _results(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("type"), (k % 7 > 2).alias("correct"), (k % 3 > 0).alias("routed"), (k % 5 > 0).alias("retrieved"), (k % 4).alias("expected_count"), (k % 6).alias("answered_count"))


@query(f"WITH {_RESULTS_SQL} SELECT CASE WHEN NOT routed THEN 'routing' WHEN NOT retrieved THEN 'retrieval' WHEN expected <> answered THEN 'count' ELSE 'other' END AS cause, count(*) AS n FROM r WHERE NOT correct GROUP BY 1")
def miss_causes(spark: SparkSession, folder: str) -> DataFrame:
    return report.misses(_results(spark, folder))


@query(f"WITH {_RESULTS_SQL} SELECT type, count(*) AS n, round(avg(answered - expected), 6) AS offset, round(avg(abs(answered - expected)), 6) AS error FROM r GROUP BY type")
def count_errors(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.count_errors(_results(spark, folder).withColumnsRenamed({"expected_count": "expected", "answered_count": "answered"}))


@query("SELECT l_orderkey AS question_id, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY l_orderkey")
def node_type_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.node_types(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("type")), ["A", "N", "R"])


@query(f"WITH {_RESULTS_SQL}, h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) AS misses, count(l_orderkey) AS had FROM r LEFT JOIN h ON l_orderkey = question_id WHERE NOT correct")
def missed_with_summary(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("type"))
    return evaluate.missed_with(_results(spark, folder), chosen, "R")


@query("SELECT conv_id, turn, contains(lower(text), 'yes') OR turn < 1 AS ok FROM conversations")
def judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.when(F.col("turn") < 1, F.concat(F.lit("Well, YES: "), "text")).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", evaluate.verdict(reply).alias("ok"))


@query("""WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'supports' AS type, least(count(*) / 3, 1)::DOUBLE AS weight FROM lineitem GROUP BY ALL UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, 'supports', 0.6 FROM lineitem GROUP BY ALL),
w AS (SELECT a.src, b.dst, a.weight * b.weight * 0.5 AS weight, a.dst AS m, row_number() OVER (PARTITION BY a.src, b.dst ORDER BY a.dst, b.dst) AS k FROM e a JOIN e b ON a.dst = b.src WHERE a.weight * b.weight * 0.5 >= 0.15)
SELECT src, dst, round(weight, 6) AS weight FROM w WHERE k = 1 ORDER BY m, src, dst LIMIT 100""")
def inference_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred by place: the cap is the operator's."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    parts = parts_of(l)
    one = l.select("l_suppkey", "l_partkey").repartition(parts, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("supports").alias("type"), F.least(F.col("n") / 3, F.lit(1.0)).alias("weight"), F.struct(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b")).alias("ord"))
    two = l.select("l_partkey", "l_orderkey").repartition(parts, "l_partkey", "l_orderkey").distinct().select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst"), F.lit("supports").alias("type"), F.lit(0.6).alias("weight"), F.struct(name("o", "l_orderkey").alias("a"), name("p", "l_partkey").alias("b")).alias("ord"))
    return reflect.inferred(one.unionByName(two)).select("src", "dst", F.round("weight", 6).alias("weight"))
