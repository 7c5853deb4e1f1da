"""Text operators as Column functions that stay on the JVM: analyzers, sentences, chunk packing, kinds, links, entities.

Word boundaries are those of ASCII (letters, digits, underscore), written as lookarounds,
since Java's own are not.  All functions are null for null texts, and give empty arrays
or strings for empty ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from .tokens import Words

LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EDGE = rf"(?:{RIGHT}(?<=[A-Za-z0-9_])|{LEFT}(?=[A-Za-z0-9_]))"
TERMINATORS = ".!?…‽。！？؟؛·ฯ।፤։｡"
MAX_SENTENCES, MIN_CHUNK, MAX_CHUNK = 3, 20, 500
PRESETS = {"fine": (300, 2), "balanced": (500, 3), "coarse": (2500, 6)}
Analyzer = Callable[[Column], Column]


@cache
def _folds() -> tuple[str, str]:
    """Lower-case letters with marks, and what they are without."""
    pairs = []
    for c in range(0xC0, 0x2000):
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)
        if len(bare) == 1 and bare.isascii() and bare.isalnum() and bare != chr(c):
            pairs.append((chr(c), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def lowered(text: Column) -> Column:
    return F.lower(text)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    source, target = _folds()
    return F.regexp_replace(F.translate(F.lower(text), source, target), "[̀-ͯ]", "")


def tokens_fold(text: Column, stopwords: frozenset[str] = lexicon.ALL_STOPWORDS) -> Column:
    """Runs of a-z and 0-9 of the folded text, of two characters or more, that are no stop words; in order, with repetitions."""
    stop = sorted(w for w in stopwords if w.isascii() and len(w) > 1)
    words = F.split(F.regexp_replace(folded(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def tokens_unicode(text: Column) -> Column:
    """Runs of letters, numbers and marks of two characters or more, in lower case, marks kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1), lambda w: F.length(w) > 1)


def tokens_locale(text: Column, lang: str) -> Column:
    """tokens_unicode() by a language's case rules and without its stop words; of an unknown language, without those of all."""
    cased = F.translate(text, "İI", "iı") if lang == "tr" else text
    stop = sorted(lexicon.STOPWORDS.get(lang, lexicon.ALL_STOPWORDS))
    return F.filter(tokens_unicode(cased), lambda w: ~w.isin(stop))


def batched(analyzer: Analyzer) -> tuple[Analyzer, Words] | None:
    """How an analyzer works on whole batches in Python: what the text is made before, and the words of that; None for analyzers of one's own."""
    return getattr(analyzer, "batched", None)


tokens_fold.batched = (lowered, Words(_folds(), frozenset(w for w in lexicon.ALL_STOPWORDS if w.isascii() and len(w) > 1)))  # type: ignore[attr-defined]
tokens_unicode.batched = (lowered, Words())  # type: ignore[attr-defined]


def locale(lang: str) -> Analyzer:
    """tokens_locale() of a language."""
    out = lambda t: tokens_locale(t, lang)
    before = (lambda t: F.lower(F.translate(t, "İI", "iı"))) if lang == "tr" else lowered
    out.batched = (before, Words(stop=frozenset(lexicon.STOPWORDS.get(lang, lexicon.ALL_STOPWORDS))))  # type: ignore[attr-defined]
    return out


ANALYZERS: dict[str, Analyzer] = {"ascii-fold": tokens_fold, "unicode": tokens_unicode} | {f"locale-{lang}": locale(lang) for lang in lexicon.STOPWORDS}


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Text cut behind terminators, without blanks around and empty pieces."""
    cut = F.split(F.regexp_replace(text, f"([{TERMINATORS}])\\s*", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def packed(parts: Column, max_sentences: int = MAX_SENTENCES, max_chars: int = MAX_CHUNK) -> Column:
    """Sentences joined greedily; a chunk ends with the sentence that fills or overflows it."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        full = (acc["n"] + 1 >= max_sentences) | (F.length(joined) > max_chars)
        return F.struct(
            F.when(full, F.lit("")).otherwise(joined).alias("open"),
            F.when(full, F.lit(0)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunks(text: Column, max_chars: int = MAX_CHUNK, max_sentences: int = MAX_SENTENCES, min_chars: int = MIN_CHUNK) -> Column:
    """Paragraphs that fit stay whole, longer ones are packed sentences; pieces of fewer than min_chars are dropped."""
    pieces = F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(packed(sentences(p), max_sentences, max_chars))))
    return F.filter(pieces, lambda c: F.length(c) >= min_chars)


def normal(text: Column) -> Column:
    """Lower-case words between single blanks, one at either end: what cues are looked for in."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "), F.lit(" "))


def cued(normalised: Column, cues: Iterable[str]) -> Column:
    """Whether a text in normal form has one of the cues, in which "_" stands for a blank. Substrings are found without a pattern, in one scan each;
    as a loop over a constant array, since an expression for each cue would be more code than the JVM compiles."""
    return F.exists(F.lit([c.replace("_", " ") for c in cues]), lambda c: F.contains(normalised, c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cued_sql(normalised: str, cues: Iterable[str]) -> str:
    """cued() in DuckDB."""
    return "(" + " OR ".join(f"contains({normalised}, '{c.replace('_', ' ')}')" for c in cues) + ")"


DATES = r"\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:in|im|en|nel|em|în|w|в) (?:\p{L}+ )?\d{4}|(?:on|am|el|le|il) (?:\p{L}+ )?\d{1,2}"
MAGNITUDES = "thousand million billion trillion tausend mrd mio mil millon millón mille milliard mila milion miliard mii milioan tysi bin milyon milyar тыс млн млрд миллион миллиард 千 万 亿 億 兆 만 억 조 हज़ार लाख करोड़ ألف مليون مليار".split()
DATA = r"\d\s?%|[$€£¥₹₽₩₺฿]\s?\d|\d\s*(?:" + "|".join(MAGNITUDES) + ")"


def kind(text: Column) -> Column:
    """definition, event, data-point, claim or fact: the first whose cues the text has; dates make events, amounts data points, and only short texts define."""
    low, digits = F.lower(text), text.rlike("[0-9]")
    told = lambda norm: (
        F.when((F.length(text) < 200) & cued(norm, lexicon.DEFINITION_CUES), "definition")
        .when(digits & low.rlike(DATES), "event")
        .when(cued(norm, lexicon.EVENT_CUES), "event")
        .when(digits & low.rlike(DATA), "data-point")
        .when(cued(norm, lexicon.CLAIM_CUES), "claim")
        .otherwise("fact")
    )
    return F.when(text.isNotNull(), let(normal(text), told))


def kinds(texts: DataFrame, text: str) -> DataFrame:
    """The rows with kind() of a column in its place, by automata over whole batches instead of a scan for each cue."""
    others = [c for c in texts.columns if c != text]
    cues = lambda c: "|".join(re.escape(x.replace("_", " ")) for x in c)
    definition, event, claim = cues(lexicon.DEFINITION_CUES), cues(lexicon.EVENT_CUES), cues(lexicon.CLAIM_CUES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, low, norm = (batch.column(k) for k in range(3))
            has = pc.match_substring_regex
            digits = has(low, "[0-9]")
            dated, data = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            at = np.flatnonzero(digits.fill_null(False).to_numpy(zero_copy_only=False))
            some = low.take(pa.array(at))
            dated[at], data[at] = (has(some, p).to_numpy(zero_copy_only=False) for p in (DATES, DATA))
            tests = [pc.and_(pc.less(size, 200), has(norm, definition)), pc.or_(pa.array(dated), has(norm, event)), pa.array(data), has(norm, claim)]
            names = pc.case_when(pc.make_struct(*tests), *(pa.scalar(k) for k in ("definition", "event", "data-point", "claim", "fact")))
            yield pa.RecordBatch.from_arrays([*(batch.column(3 + k) for k in range(len(others))), pc.if_else(pc.is_valid(low), names, pa.scalar(None, pa.string()))], names=[*others, text])

    t = F.col(text)
    kept = texts.select(F.length(t).alias("size"), F.lower(t).alias("low"), normal(t).alias("norm"), *others)
    return kept.mapInArrow(run, T.StructType([*(texts.schema[c] for c in others), T.StructField(text, T.StringType())]))


def kind_sql(text: str) -> str:
    """kind() in DuckDB."""
    norm = rf"(' ' || regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g') || ' ')"
    return f"""CASE WHEN {text} IS NULL THEN NULL WHEN len({text}) < 200 AND {cued_sql(norm, lexicon.DEFINITION_CUES)} THEN 'definition' WHEN regexp_matches(lower({text}), '{DATES}') OR {cued_sql(norm, lexicon.EVENT_CUES)} THEN 'event'
WHEN regexp_matches(lower({text}), '{DATA}') THEN 'data-point' WHEN {cued_sql(norm, lexicon.CLAIM_CUES)} THEN 'claim' ELSE 'fact' END"""


LINK_CHARS = 256 * 1024


def links(text: Column, most: int = LINK_CHARS) -> Column:
    """Targets of [text](target), then of [[target]], in the first so many characters."""
    scan = F.substring(text, 1, most)
    inline = F.regexp_extract_all(scan, F.lit(r"\[([^\]]{1,500})\]\(([^)\s]{1,2048})\)"), 2)
    return F.when(F.contains(text, F.lit("[")), F.concat(inline, F.regexp_extract_all(scan, F.lit(r"\[\[([^\]]{1,500})\]\]"), 1))).otherwise(_none(text))


def defined_term(text: Column) -> Column:
    """What a definition defines: the subject before the first defining verb, else null."""
    verbs = r"\s+(?:is defined as|refers to|is an?|means|are)\s"
    return F.nullif(F.trim(F.regexp_extract(text, r"^\s*(?:The |An? )?([^.\n]{2,80}?)" + verbs, 1)), F.lit(""))


def _all(pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda t: F.regexp_extract_all(t, F.lit(pattern), group)


def _script(ranges: str, least: int = 2) -> Callable[[Column], Column]:
    return _all(f"([{ranges}]{{{least},}})")


def _single_names(text: Column) -> Column:
    words = F.slice(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), 2, 1 << 30)
    return F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}\p{Ll}+$") & ~w.isin(sorted(lexicon.NOT_NAMES)))


def _quoted(text: Column) -> Column:
    marks = [('"', '"'), ("'", "'"), ("«", "»"), ("„", "“"), ("「", "」"), ("『", "』"), ("“", "”")]
    found = F.regexp_extract_all(text, F.lit("(" + "|".join(f"{a}[^{b}]+{b}" for a, b in marks) + ")"), 1)
    return F.filter(F.transform(found, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), lambda q: (F.length(q) > 1) & (F.length(q) < 100))


#: Symbols of units of the SI and of common use, longer ones before their beginnings, and codes of ISO 4217.
UNITS = "mm cm km kg mg kWh kW MW GW kHz MHz GHz Hz KB MB GB TB PB min ms ns µs μs ml mi ft in yd lb oz °C °F % m g t l s h W V A K".split()
CODES = "AED ARS AUD BGN BRL CAD CHF CNY CZK DKK EGP EUR GBP HKD HUF IDR ILS INR JPY KRW MXN NOK NZD PLN RON RUB SAR SEK SGD THB TRY UAH USD ZAR".split()


def _none(text: Column) -> Column:
    """No entities; null for null."""
    return F.when(text.isNotNull(), F.array().cast("array<string>"))


def _if(test: Callable[[Column], Column], extract: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The extractor, run only on texts that pass a cheap test which every text with a find passes."""
    return lambda t: F.when(test(t), extract(t)).otherwise(_none(t))


def _with(*signs: str) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda x, y: x | y, (F.contains(t, F.lit(s)) for s in signs))


_DIGIT = lambda t: t.rlike("[0-9]")
_FAR = lambda t: t.rlike(r"[\x{0590}-\x{FFFF}]")  # noqa: E731  any script beyond Latin, Greek, Cyrillic and Armenian


#: In this order; an entity keeps the place of its first find.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "phrases": _all(r"(\p{Lu}\p{Ll}+(?:[\s\-]\p{Lu}\p{Ll}+)+)"),
    "names": _single_names,
    "cjk": _if(_FAR, _script(r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}")),
    "katakana": _if(_FAR, _script(r"\x{30A0}-\x{30FF}")),
    "hangul": _if(_FAR, _script(r"\x{AC00}-\x{D7AF}")),
    "indic": _if(_FAR, _script(r"\x{0900}-\x{0D7F}")),
    "arabic": _if(_FAR, _script(r"\x{0600}-\x{06FF}\x{0750}-\x{077F}")),
    "hebrew": _if(_FAR, _script(r"\x{0590}-\x{05FF}")),
    "thai": _if(_FAR, _script(r"\x{0E00}-\x{0E7F}")),
    "georgian": _if(_FAR, _script(r"\x{10A0}-\x{10FF}")),
    "ethiopic": _if(_FAR, _script(r"\x{1200}-\x{137F}")),
    "myanmar": _if(_FAR, _script(r"\x{1000}-\x{109F}")),
    "khmer": _if(_FAR, _script(r"\x{1780}-\x{17FF}")),
    "tibetan": _if(_FAR, _script(r"\x{0F00}-\x{0FFF}")),
    "sinhala": _if(_FAR, _script(r"\x{0D80}-\x{0DFF}")),
    "years": _if(_DIGIT, _all(LEFT + r"(1[0-9]{3}|20[0-9]{2})" + RIGHT)),
    "iso_dates": _if(_DIGIT, _all(LEFT + r"(\d{4}-\d{2}-\d{2})" + RIGHT)),
    "day_dates": _if(_DIGIT, _all(LEFT + r"(\d{1,2}[./]\d{1,2}[./]\d{2,4})" + RIGHT)),
    "acronyms": lambda t: F.filter(_all(EDGE + r"(\p{Lu}{2,})" + EDGE)(t), lambda w: ~w.isin(sorted(lexicon.NOT_ACRONYMS))),
    "backticks": _if(_with("`"), _all(r"`([^`]+)`")),
    "camel": _if(lambda t: t.rlike("[a-z][A-Z]"), _all(LEFT + r"([a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]+)+)" + RIGHT)),
    "dotted": _if(lambda t: t.rlike("[A-Za-z0-9_][.][A-Za-z0-9_]"), _all(LEFT + r"([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+)" + RIGHT)),
    "quoted": _if(_with(*"\"'«„「『“"), _quoted),
    "parenthesised": _if(_with("("), lambda t: F.filter(_all(r"\(([^)]{2,60})\)")(t), lambda w: w.rlike(r"\p{L}"))),
    "emails": _if(_with("@"), _all(LEFT + r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,})" + RIGHT)),
    "urls": _if(_with("://"), _all(LEFT + r"(https?://[^\s<>\"')\]]+)")),
    "tags": _if(_with("#", "@"), _all(r"(?:^|[\s(])([#@][A-Za-z0-9_\p{L}]{2,})")),
    "measures": _if(_DIGIT, _all(EDGE + r"(\d+(?:[.,]\d+)?\s*(?:" + "|".join(UNITS) + "))" + EDGE)),
    "money": _if(_DIGIT, _all(r"([$€£¥₹₽₩₺฿]\s?\d+(?:[.,]\d+)*|" + LEFT + r"\d+(?:[.,]\d+)*\s?(?:" + "|".join(CODES) + ")" + RIGHT + ")")),
}


def entities(text: Column) -> Column:
    """The distinct entities of all extractors, in the order of EXTRACTORS."""
    return F.array_distinct(F.concat(*(extract(text) for extract in EXTRACTORS.values())))


def content_hash(text: Column) -> Column:
    """Key of equal contents."""
    return F.sha2(text, 256)


def compatible_hash(text: Column) -> Column:
    """The 32-bit multiplicative string hash in base 36, from UTF-16 units, as kept by old files; too short to be a key of equal contents."""
    units = F.encode(text, "UTF-16BE")
    pairs = F.when(F.length(units) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(units), F.lit(1)), F.lit(2)), lambda i: F.conv(F.hex(F.substring(units, i, F.lit(2))), 16, 10).cast("bigint")))
    wrapped = F.aggregate(pairs, F.lit(5381).cast("bigint"), lambda h, u: (h * 33 + u) % F.lit(1 << 32))
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    return F.concat(F.when(signed < 0, F.lit("-")).otherwise(F.lit("")), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def person_like(name: Column) -> Column:
    """Two words or more, each a capital and small letters."""
    return name.rlike(r"^\p{Lu}\p{Ll}+(\s+\p{Lu}\p{Ll}+)+$")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def year(text: Column) -> Column:
    """The first year from 1000 to 2029, or null."""
    return F.nullif(F.regexp_extract(text, LEFT + r"(1\d{3}|20[0-2]\d)" + RIGHT, 1), F.lit("")).cast("int")


def millis(time: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_millis(time.cast("timestamp"))


#: Somebody says that something is not, or no longer, so.
CONFLICT_CUES = """_no_longer_ _not_the_ _not_a_ _not_an_ _never_was_ _was_never_ _were_never_ _is_false_ _was_false_ _is_wrong_ _was_wrong_ _is_incorrect_ _was_incorrect_
    _untrue_ _inaccurate_ _disproved_ _disproven_ _refuted_ _retracted_ _disputed_ _denies_ _denied_that_ _contradicts_ _contrary_to_ _replaced_by_ _superseded_by_
    _reclassified_ _renamed_ _turned_out_not_ _mistakenly_ _nicht_mehr_ _ist_falsch_ _ya_no_ _es_falso_ _n_est_plus_ _est_faux_ _non_è_più_ _è_falso_ _já_não_ _é_falso_""".split()


def conflicting(text: Column) -> Column:
    """Whether the text says that something is not, or no longer, so."""
    return let(normal(text), lambda norm: cued(norm, CONFLICT_CUES))


def _units(text: Column) -> Column:
    """The UTF-16 units as numbers."""
    data = F.encode(text, "UTF-16BE")
    return F.when(F.length(data) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1)), F.lit(2)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(2))), 16, 10).cast("bigint")))


def redacted(name: Column) -> Column:
    """A short stable token for logs in place of a name: the 32-bit FNV-1a hash of its UTF-16 units in hexadecimal; zeros for null and empty."""
    h = F.aggregate(_units(name), F.lit(0x811C9DC5).cast("bigint"), lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(0x01000193), F.lit(1 << 32)))
    return F.when(F.length(name) > 0, F.lpad(F.lower(F.hex(h)), 8, "0")).otherwise("00000000")


#: Somebody demands, or says what they like.
DEMAND_CUES = "_should_ _must_ _prefer_ _prefers_ _always_ _never_ _favourite_ _favorite_ _want_ _wants_ _please_".split()


def correction_kind(text: Column) -> Column:
    """What a correction is: definition, event, preference or fact, the first whose cues it has."""
    told = lambda n: F.when(cued(n, lexicon.DEFINITION_CUES), "definition").when(text.rlike("[0-9]") & F.lower(text).rlike(DATES) | cued(n, lexicon.EVENT_CUES), "event").when(cued(n, DEMAND_CUES), "preference").otherwise("fact")
    return F.when(text.isNotNull(), let(normal(text), told))


def correction_kind_sql(text: str) -> str:
    norm = rf"(' ' || regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g') || ' ')"
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {cued_sql(norm, lexicon.DEFINITION_CUES)} THEN 'definition' WHEN regexp_matches(lower({text}), '{DATES}') OR {cued_sql(norm, lexicon.EVENT_CUES)} THEN 'event' WHEN {cued_sql(norm, DEMAND_CUES)} THEN 'preference' ELSE 'fact' END"


def normal_date(text: Column) -> Column:
    """A date like 2023/05/20 (Sat) or 2023-05-20T10:00:00 as 2023-05-20 (Sat); without a weekday where the first form has none; other texts as they are,
    null as empty."""
    slashed = r"^(\d{4})/(\d{2})/(\d{2})\s*(?:\(([A-Za-z]{3})\))?"
    part = lambda k: F.regexp_extract(text, slashed, k)
    day = F.when(part(4) != "", F.concat(F.lit(" ("), part(4), F.lit(")"))).otherwise("")
    time = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?Z?)?$"), text))
    other = F.coalesce(F.date_format(time, "yyyy-MM-dd (EEE)"), text)
    return F.when(text.isNull(), "").when(text.rlike(slashed), F.concat(F.concat_ws("-", part(1), part(2), part(3)), day)).otherwise(other)


NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty".split(), [*range(21), 30, 40, 50]))


def number(text: Column) -> Column:
    """The first number of a text in digits, else the least of those it has as words, else null."""
    digits = F.regexp_extract(text, LEFT + r"(\d+(?:\.\d+)?)" + RIGHT, 1)
    words = F.expr("null").cast("double")
    for word, value in reversed(NUMBER_WORDS.items()):
        words = F.when(F.array_contains(F.split(F.lower(text), "[^a-z0-9_]+"), word), float(value)).otherwise(words)
    return F.when(digits != "", digits.cast("double")).otherwise(words)
