"""Secret scans by grammar inference.

For each credential format a prefix tree of labelled examples becomes an acyclic
probabilistic automaton: level by level, states are merged whose next-symbol distributions,
and recursively those of their successors, agree within Hoeffding bounds.  For formats of fixed length levels are kept apart, so
an automaton knows how long its format is.  Formats of open length (OPEN) keep apart only
the levels before the first that may end a part; the ones from there are a loop, so strings
of any length match, but only of symbols that were seen there.  All candidate strings of all
texts are scored by the likelihood ratio of each automaton against a bigram model of ordinary
strings; a format's threshold lies between its held-out examples and held-out ordinary strings.

Formats without a literal mark (hex and base64; of one's own labelled credentials those
that one names as generic) count only after a word such as "token", "key" or "password" with an assignment sign.  Candidates are maximal runs of
letters, digits and _-+/. of at least SHORTEST characters, and their pieces between slashes
and dots, also with a slash on one side and a dot on the other, of any length.  A credential that is glued to more letters or digits is part of a longer run,
and is not looked for inside it; keys of several lines are not among the formats.  Overlapping
finds: the first of the longest stays.  Null and empty texts have no finds.  Rows that
repeat are each scanned.  Offsets count characters.  An empty table gives an empty result;
scan() reads doc_id and text alone, so other columns cannot clash, and redact() hands them on.
"""

from __future__ import annotations

import re
import string
import sys
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, over, replaced, strings

SHORTEST, EXAMPLES, ALPHA, SMOOTH, SEED = 16, 600, 0.05, 0.05, 5
SYMBOLS = 128
END = SYMBOLS
RUN = re.compile(r"[A-Za-z0-9_+/.\-]{%d,}={0,2}" % SHORTEST)
KEYED = re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|auth|credential|bearer)[\w\-]{0,20}[\"']?\s{0,3}(?:[:=]|:=|=>)\s{0,3}[\"'`]?$")
CONTEXT = 48
_UP, _LOW, _DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
GENERIC = {"hex_short", "hex32", "hex40", "hex64", "base64_40", "hex", "base64"}
OPEN = {"jwt", "hex", "base64"}
MARKS = (ord("."), ord("="))  # end a part of a format of open length
LONG = 256  # longer strings are scored one by one, shorter ones in matrices


def labelled(n: int = EXAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """Seeded examples by format, made from the formats' public descriptions; "" has ordinary strings."""
    rng = np.random.default_rng(seed)
    some = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    pick = lambda *x: x[rng.integers(0, len(x))]
    alnum, url = _UP + _LOW + _DIG, _UP + _LOW + _DIG + "-_"
    hexa = _DIG + "abcdef"
    hexes = lambda k: pick(str.lower, str.upper)(some(hexa, k))
    syllables = "th er on an re ing ed en at ou st nd sch ein ver qui ment tion la el ci os ra de com io al is".split()
    word = lambda a, b: "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(a, b)))
    ordinary = (
        lambda: word(6, 14),
        lambda: word(2, 5) + pick("-", "_", ".", "/") + word(2, 5) + pick("-", "_", ".", "/") + word(2, 4),
        lambda: some(_DIG, rng.integers(16, 24)),
        lambda: word(2, 4) + "." + some(_DIG, 2) + "." + word(2, 4) + ".example.com",
        lambda: word(3, 6).capitalize() + word(3, 6).capitalize() + some(_DIG, rng.integers(0, 4)),
        lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: pick("www.", "", "docs.") + word(2, 4) + ".org/" + word(2, 5) + "/" + some(_DIG, 4) + "/" + word(2, 5),
        lambda: (word(5, 9)).upper(),
    )
    formats = {
        "aws_access_key_id": lambda: pick("AKIA", "ASIA") + some(_UP + "234567", 16),
        "github_token": lambda: "gh" + pick("p", "o", "u", "s", "r") + "_" + some(alnum, 36),
        "slack_token": lambda: "xox" + pick("b", "p") + "-" + some(_DIG, 12) + "-" + some(_DIG, 12) + "-" + some(alnum, 24),
        "stripe_key": lambda: pick("sk", "rk") + "_live_" + some(alnum, 24),
        "google_api_key": lambda: "AIza" + some(url, 35),
        "npm_token": lambda: "npm_" + some(alnum, 36),
        "jwt": lambda: "eyJ" + some(url, rng.integers(17, 40)) + ".eyJ" + some(url, rng.integers(20, 80)) + "." + some(url, 43),
        "hex_short": lambda: hexes(rng.integers(16, 32)),
        "hex32": lambda: hexes(32),
        "hex40": lambda: hexes(40),
        "hex64": lambda: hexes(64),
        "base64_40": lambda: some(alnum + "+/", 40),
    }
    out = {name: [make() for _ in range(n)] for name, make in formats.items()} | {"": [ordinary[i % len(ordinary)]() for i in range(2 * n)]}
    # every other JWT has a payload and signature of other lengths
    out["jwt"][::2] = ["eyJ" + some(url, rng.integers(17, 40)) + ".eyJ" + some(url, rng.integers(6, 80)) + "." + some(url, pick(43, 64, 86, 342)) for _ in out["jwt"][::2]]
    out["hex"] = [hexes(rng.integers(16, 129)) for _ in range(n)]
    out["base64"] = [some(alnum + "+/", rng.integers(16, 129)) + pick("", "=", "==") for _ in range(n)]
    return out


@dataclass
class Automaton:
    next: np.ndarray  # state, symbol -> state
    logp: np.ndarray  # state, symbol or END -> log-probability
    depth: int


def infer(examples: list[str], alpha: float = ALPHA, smooth: float = SMOOTH) -> Automaton:
    """The automaton of one format; states are merged with the first compatible one of their level, largest first.

    Two states are compatible if their next-symbol distributions agree within Hoeffding bounds, and so do, recursively, the states that the same
    symbol leads to from both; pairs of so few examples that nothing could tell them apart end the recursion."""
    text = [np.frombuffer(e.encode("ascii"), np.uint8) for e in examples]
    depth = max(map(len, text))
    symbol = np.full((len(text), depth + 1), END)
    for i, t in enumerate(text):
        symbol[i, : len(t)] = t
    bound = np.sqrt(0.5 * np.log(2 / alpha))

    def compatible(a: np.ndarray, b: np.ndarray, level: int) -> bool:
        width = bound * (len(a) ** -0.5 + len(b) ** -0.5)
        if width >= 1 or level > depth:
            return True
        x, y = symbol[a, level], symbol[b, level]
        p, q = np.bincount(x, minlength=SYMBOLS + 1), np.bincount(y, minlength=SYMBOLS + 1)
        if (np.abs(p / len(a) - q / len(b)) >= width).any():
            return False
        both = np.flatnonzero((p > 1) & (q > 1) & (np.arange(SYMBOLS + 1) != END))
        return all(compatible(a[x == c], b[y == c], level + 1) for c in both)

    state = np.zeros(len(text), np.int64)  # of the examples, in the level; -1: ended
    counts, arrows, offset = [], [], 0
    for level in range(depth + 1):
        live = state >= 0
        n_states = int(state.max()) + 1
        table = np.zeros((n_states, SYMBOLS + 1))
        np.add.at(table, (state[live], symbol[live, level]), 1)
        counts.append(table)
        going = live & (symbol[:, level] != END)
        if not going.any():
            arrows.append(np.full((n_states, SYMBOLS), -1))
            break
        code = state[going] * SYMBOLS + symbol[going, level]
        nodes, node = np.unique(code, return_inverse=True)
        order = np.argsort(node, kind="stable")
        members = np.split(np.flatnonzero(going)[order], np.cumsum(np.bincount(node))[:-1])
        merged, to = [], np.zeros(len(nodes), np.int64)
        for k in np.argsort([-len(m) for m in members], kind="stable"):
            own = members[k]
            s = next((s for s, held in enumerate(merged) if compatible(own, held, level + 1)), len(merged))
            to[k] = s
            if s == len(merged):
                merged.append(own)
            else:
                merged[s] = np.concatenate([merged[s], own])
        arrow = np.full((n_states, SYMBOLS), -1)
        arrow[nodes // SYMBOLS, nodes % SYMBOLS] = to
        heaviest = int(np.argmax([len(m) for m in merged]))
        arrow[arrow < 0] = heaviest  # a symbol that was never seen here is improbable, not impossible
        arrows.append(arrow)
        state = np.full(len(text), -1)
        state[going] = to[node]
    nexts = []
    for table, arrow in zip(counts, arrows):
        nexts.append(np.where(arrow < 0, -1, arrow + offset + len(table)))
        offset += len(table)
    table = np.concatenate(counts)
    logp = np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * (SYMBOLS + 1)))
    return Automaton(np.concatenate(nexts), logp, depth)


def infer_open(examples: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a format of open length; what was not seen in a state is impossible there."""
    counts: dict[tuple[int, int], np.ndarray] = {}  # by marks before and level behind the last of them
    for e in examples:
        part = level = 0
        for c in [*e.encode("ascii"), END]:
            counts.setdefault((part, level), np.zeros(SYMBOLS + 1))[c] += 1
            part, level = (part + 1, 0) if c in MARKS else (part, level + 1)
    bound = np.sqrt(0.5 * np.log(2 / alpha))
    exits = np.isin(np.arange(SYMBOLS + 1), [*MARKS, END])

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        n, k = x.sum(), y.sum()
        return bool(n and k and (np.abs(x / n - y / k) < bound * (n**-0.5 + k**-0.5)).all())

    states: list[list] = []  # part, symbols and ends counted, group of its symbols
    pools: list[tuple[int, np.ndarray]] = []  # part and symbols counted in all compatible levels of it
    for part, level in sorted(counts):
        ends, letters = np.where(exits, counts[part, level], 0), np.where(exits, 0, counts[part, level])
        last = states[-1] if states and states[-1][0] == part else None
        if last and last[2].any() and (not letters.any() or alike(pools[last[3]][1], letters)):
            last[1], last[2] = last[1] + letters, last[2] + ends
            pools[last[3]] = part, pools[last[3]][1] + letters
            continue
        group = next((g for g in range(len(pools) - 1, -1, -1) if pools[g][0] == part and alike(pools[g][1], letters)), len(pools))
        if group == len(pools):
            pools.append((part, letters))
        else:
            pools[group] = part, pools[group][1] + letters
        states.append([part, letters, ends, group])
    parts = [s[0] for s in states]
    following, p = np.zeros((len(states), SYMBOLS), np.int64), np.zeros((len(states), SYMBOLS + 1))
    for i, (part, letters, ends, group) in enumerate(states):
        total, pool = letters.sum() + ends.sum(), pools[group][1]
        p[i] = ends / total + (letters.sum() / total * pool / pool.sum() if letters.any() else 0)
        following[i] = i + 1 if i + 1 < len(states) and parts[i + 1] == part else i
        following[i, list(MARKS)] = parts.index(part + 1) if part + 1 in parts else i
    with np.errstate(divide="ignore"):
        return Automaton(following, np.log(p), sys.maxsize)


@dataclass
class Scanner:
    names: list[str]
    automata: list[Automaton]
    bigram: np.ndarray
    thresholds: np.ndarray
    open: frozenset[str] = frozenset(OPEN)
    generic: frozenset[str] = frozenset(GENERIC)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    m = np.full((len(texts), int(sizes.max()) + 1), END)
    for i, t in enumerate(texts):
        m[i, : sizes[i]] = np.frombuffer(t.encode("ascii"), np.uint8)
    return m, sizes


def likelihood(a: Automaton, m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-likelihood of each string; -inf if it is longer than the automaton is deep."""
    out = np.zeros(len(m))
    state = np.zeros(len(m), np.int64)
    out[sizes > a.depth] = -np.inf
    for k in range(min(a.depth, m.shape[1] - 1) + 1):
        on = (k <= sizes) & np.isfinite(out)
        if not on.any():
            break
        s = m[on, k]
        out[on] += a.logp[state[on], s]
        state[on] = np.where(s == END, 0, a.next[state[on], np.minimum(s, SYMBOLS - 1)])
    return out


def ratios(sc: Scanner, texts: list[str]) -> np.ndarray:
    """Log-likelihood ratios: strings by formats."""
    m, sizes = _matrix(texts)
    before = np.concatenate([np.full((len(m), 1), END), m[:, :-1]], axis=1)
    background = np.where(np.arange(m.shape[1])[None] <= sizes[:, None], sc.bigram[before, m], 0).sum(axis=1)
    return np.stack([likelihood(a, m, sizes) - background for a in sc.automata], axis=1)


def prefix_ratios(sc: Scanner, text: str, ends: list[int]) -> np.ndarray:
    """ratios() of the prefixes of one text that have these lengths, in one pass an automaton."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64)
    before = np.concatenate([[END], codes])
    background = np.concatenate([[0.0], np.cumsum(sc.bigram[before[:-1], codes])]) + sc.bigram[before, END]
    out = np.full((len(ends), len(sc.automata)), -np.inf)
    for k, a in enumerate(sc.automata):
        state, total, got = 0, 0.0, np.full(len(codes) + 1, -np.inf)
        logp, following = a.logp.tolist(), a.next.tolist()
        for at, s in enumerate([*codes[: a.depth].tolist(), END]):
            got[at] = total + logp[state][END]
            if s == END or (total := total + logp[state][s]) == -np.inf:
                break
            state = following[state][s]
        out[:, k] = got[ends] - background[ends]
    return out


@cache
def scanner(n: int = EXAMPLES, seed: int = SEED) -> Scanner:
    """The scanner of the examples that are made here; once in a process."""
    return learned(labelled(n, seed))


def labelled_rows(rows: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """Examples by format from a table (format, text), where the empty format marks ordinary strings. More rows than most are an error; null and empty
    texts and those with other characters than ASCII are left out."""
    got = rows.select(F.col("format").cast("string"), F.col("text").cast("string")).where("text != '' and format is not null").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} labelled strings")
    out: dict[str, list[str]] = {}
    for name, text in sorted(map(tuple, got)):
        if text.isascii():
            out.setdefault(name, []).append(text)
    for name, texts in out.items():
        np.random.default_rng(SEED).shuffle(texts)
        if len(texts) < 4:
            raise ValueError(f"{name or 'ordinary strings'}: at least four examples are needed")
    if "" not in out or len(out) < 2:
        raise ValueError("both credentials and ordinary strings (format '') are needed")
    return out


def learned(examples: dict[str, list[str]], open_: frozenset[str] = frozenset(OPEN), generic: frozenset[str] = frozenset(GENERIC)) -> Scanner:
    """Automata of three quarters of each format's examples, thresholds of the rest. open_: formats of open length; generic: those that count only behind a key."""
    examples = dict(examples)
    plain = examples.pop("")
    cut = lambda x: (x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :])
    table = np.full((SYMBOLS + 1, SYMBOLS + 1), 0.5)
    for t in cut(plain)[0]:
        codes = [END, *t.encode("ascii"), END]
        np.add.at(table, (codes[:-1], codes[1:]), 1)
    sc = Scanner(list(examples), [(infer_open if name in open_ else infer)(cut(x)[0]) for name, x in examples.items()], np.log(table / table.sum(axis=1, keepdims=True)), np.zeros(0), open_, generic)
    rejected = ratios(sc, cut(plain)[1]).max(axis=0)
    lowest = lambda r: np.quantile(r[np.isfinite(r)], 0.005)
    accepted = np.array([lowest(ratios(sc, cut(x)[1])[:, k]) for k, x in enumerate(examples.values())])
    sc.thresholds = np.where(accepted > rejected, 0.75 * accepted + 0.25 * np.maximum(rejected, 0), accepted)
    return sc


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that a format can fill: runs, their pieces by "/", by "." and by both, three of the latter with
    dots between (JWT), and behind a key the run's beginnings up to a separator, the first dot at the furthest (base64)."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-+/":
            b -= 1
        spans = {(a, b)}
        for sign in "/.":
            if sign in text[a:b]:
                at = a
                for piece in text[a:b].split(sign):
                    spans.add((at, at + len(piece)))
                    at += len(piece) + 1
        cuts = [i for i in range(a, b) if text[i] in "/."]
        places = [a - 1, *cuts, b]
        spans |= {(x + 1, y) for x, y in zip(places, places[1:])}
        spans |= {(x + 1, y) for x, p, q, y in zip(places, places[1:], places[2:], places[3:]) if text[p] == text[q] == "."}
        if cuts and KEYED.search(text[max(0, a - CONTEXT) : a]):
            for i in cuts:
                spans.add((a, i))
                if text[i] == ".":
                    break
        out += sorted(s for s in spans if s[1] - s[0] >= SHORTEST)
    return out


def finds(texts: list[str | None], sc: Scanner) -> list[tuple[int, int, int, str, float, bool]]:
    """(text, start, end, format, score, keyed) of what counts as a credential, in order."""
    spots = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t)]
    short = [x for x in spots if x[2] - x[1] <= LONG]
    long: dict[tuple[int, int], list[int]] = {}
    for i, a, b in spots:
        if b - a > LONG:
            long.setdefault((i, a), []).append(b - a)
    scored = ((short[p : p + 4096], None) for p in range(0, len(short), 4096))
    scored = chain(scored, (([(i, a, a + n) for n in ends], prefix_ratios(sc, texts[i][a : a + max(ends)], ends)) for (i, a), ends in long.items()))
    out: list[tuple[int, int, int, str, float, bool]] = []
    for part, ratio in scored:
        if ratio is None:
            ratio = ratios(sc, [texts[i][a:b] for i, a, b in part])
        over_by = ratio - sc.thresholds
        for k in np.flatnonzero((over_by >= 0).any(axis=1)):
            i, a, b = part[k]
            keyed = bool(KEYED.search(texts[i][max(0, a - CONTEXT) : a]))
            allowed = [f for f in np.flatnonzero(over_by[k] >= 0) if keyed or sc.names[f] not in sc.generic]
            if allowed:
                f = max(allowed, key=lambda f: (sc.names[f] not in sc.open, ratio[k, f], -f))  # one of known length first
                out.append((i, a, b, sc.names[f], float(round(ratio[k, f] / (b - a), 4)), keyed))
    kept: list[tuple[int, int, int, str, float, bool]] = []
    for x in sorted(out, key=lambda x: (x[0], -(x[2] - x[1]), x[1])):
        k = bisect(kept, x[:2], key=lambda y: y[:2])  # kept ones are in order and do not overlap: only the neighbours can
        if all(y[0] != x[0] or y[2] <= x[1] or x[2] <= y[1] for y in kept[max(0, k - 1) : k + 1]):
            kept.insert(k, x)
    return kept


def scan(docs: DataFrame, by: Scanner | None = None) -> DataFrame:
    """doc_id, start, end, format, score (log-likelihood ratio a character), keyed of every credential. by: a scanner of one's own examples."""
    held = docs.sparkSession.sparkContext.broadcast(by or scanner())
    schema = "doc_id long, start long, end long, format string, score double, keyed boolean"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[i], *x) for i, *x in finds(strings(batch), held.value)]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "end", "format", "score", "keyed"])

    return over(ids_and_texts(docs).where("text is not null"), schema, run)


def redact(docs: DataFrame, by: Scanner | None = None) -> DataFrame:
    """The documents with [SECRET:format] in place of each credential (n_chars follows, where it is a column); other columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(by or scanner())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = strings(batch)
        found = finds(texts, held.value)
        for i, a, b, name, _, _ in reversed(found):
            texts[i] = f"{texts[i][:a]}[SECRET:{name}]{texts[i][b:]}"
        if found:
            columns = {"text": pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            batch = replaced(batch, columns)
        yield batch

    return over(docs, docs.schema, run)
