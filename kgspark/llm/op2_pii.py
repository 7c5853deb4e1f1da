"""PII by a skip-chain conditional random field.

Sites are the blank-delimited tokens that have a digit or "@", and capitalised words behind
a name's cue ("Dr.", "name:") with all their repetitions; other tokens are observed as
"outside".  A site's label is outside, or the beginning or inside of an entity of one kind.
Potentials tie a site's features to its label, labels of neighbouring tokens to each other,
and, by skip edges, the kinds of distant sites of one document that repeat or resemble each
other: equal digits, equal address, equal word.  All sites of one key are tied to a hub, a label of
the key that is not seen, so a document of any length has one such edge a site and each site
is two edges from any other of its key; features of each are the cues at any of them.  Loopy
belief propagation over all documents of a batch at once, each until its messages settle
(after CALM rounds they are damped more and more), gives the marginals, of which the largest
is taken.
Weights are trained by pseudo-likelihood on documents made here.

Null and empty texts have no entities.  Rows that repeat are each scanned; a null doc_id
stays null.  Offsets count characters; entities of a text do not overlap.  Time grows with
the length of a text, whatever it repeats.  Of labels that are equally likely the first one
is taken.  An empty table gives an empty result; scan() reads doc_id and text alone, so other
columns cannot clash, and mask() hands them on.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids_and_texts, over, replaced, strings

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "ID", "NAME")
OUTSIDE, K = 0, 1 + 2 * len(KINDS)  # label 1 + 2 * kind begins an entity, the next one goes on
KIND_OF = np.array([0, *np.repeat(np.arange(1, len(KINDS) + 1), 2)])
FORBIDDEN, CALM, DAMPING, SETTLED = -12.0, 100, 0.3, 1e-4
TRAINING, SEED, STEPS, RATE, DECAY = 1000, 3, 200, 0.3, 1e-5

CUES = {
    "name": "mr mrs ms dr prof herr frau señor señora sr sra monsieur madame mme name nombre nom contact signed".split(),
    "phone": "tel phone call mobile fax telefon telefono teléfono tél téléphone appelez ruf handy cell".split(),
    "card": "card visa mastercard karte kreditkarte tarjeta carte amex credit".split(),
    "ip": "ip host server client addr from login".split(),
    "id": "ssn passport iban id ausweis dni steuer insurance social seguro sécurité tax".split(),
    "mail": "mail email e-mail mailto correo courriel write".split(),
    "number": "version page chapter no nr year line item sku order vol isbn token key password build step figure table".split(),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
_HIT = re.compile(r"[0-9@]")
_NAME = re.compile(r"(?<!\w)(?i:%s)[.:]?[ \t]+(?=[^\W\d_a-z])" % "|".join(sorted(CUES["name"], key=len, reverse=True)))
_WORD = re.compile(r"\S+")
#: What a text with sites has at least, in a linear-time matcher: a digit, "@", or a name's cue and a blank behind it (in any case, dotless and dotted i included).
MAY_HAVE = r"[0-9@]|(?i:%s)[.:]?[ \t]" % "|".join(w.replace("i", "[iİı]") for w in CUES["name"])
_EMAIL = re.compile(r"[^\s@,;:<>()]+@[\w\-]+(?:\.[\w\-]+)+")
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_LEAD, _TRAIL = "\"'`<[{*#_|,;:=", "\"'`>]}*#_|,;:.!?%$&=-"


def core(text: str, a: int, b: int) -> tuple[int, int]:
    """The token without the signs around it; a parenthesis stays if its other half is in the token."""
    lead = _LEAD if text.find(")", a, b) >= 0 else _LEAD + "("
    while a < b and text[a] in lead:
        a += 1
    trail = _TRAIL if text.find("(", a, b) >= 0 else _TRAIL + ")"
    while b > a and text[b - 1] in trail:
        b -= 1
    return a, b


def shape(token: str) -> str:
    """Digits as 9, letters as a or A, runs of letters shortened to one, runs of digits to at most 20."""
    out = re.sub(r"[0-9]", "9", token)
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[0].isupper() else "a", out)
    return re.sub(r"9{21,}", "9" * 20, out)


@dataclass
class Sites:
    """Sites of several documents, in order."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)  # the token before is a site too
    left: list[bool] = field(default_factory=list)  # an observed token is before
    right: list[bool] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)


def _names(text: str) -> set[int]:
    """Beginnings of tokens that are sites as names: up to three capitalised words behind a cue, and their repetitions."""
    found, words = set(), set()
    for m in _NAME.finditer(text):
        at = m.end()
        for _ in range(3):
            t = _WORD.match(text, at)
            a, b = core(text, *t.span()) if t else (at, at)
            if a == b or not text[a].isupper() or not text[a:b].replace("-", "").isalpha() or text[a:b].lower() in CUE_OF:
                break
            found.add(t.start())
            if b - a > 2:
                words.add(text[a:b])
            if b < t.end():
                break
            gap = re.compile(r"[ \t]+").match(text, t.end())
            if not gap:
                break
            at = gap.end()
    for t in _WORD.finditer(text) if words else ():
        a, b = core(text, *t.span())
        if text[a:b] in words:
            found.add(t.start())
    return found


def _key(token: str) -> str:
    digits = re.sub(r"\D", "", token)
    if "@" not in token and len(digits) >= 5 and len(digits) * 2 > len(token):
        return digits[-10:]  # with or without the code of a country
    return token.casefold()


def add_sites(s: Sites, doc: int, text: str) -> None:
    begins = set()
    pos = 0
    while m := _HIT.search(text, pos):
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        pos = _WORD.match(text, a).end()
        begins.add(a)
    begins |= _names(text)
    before_end, first_site = -1, len(s.doc)
    for a in sorted(begins):
        raw_end = _WORD.match(text, a).end()
        x, y = core(text, a, raw_end)
        if x == y:
            continue
        token = text[x:y]
        head = text[max(0, a - 64) : a]
        near = bool(head) and before_end >= 0 and not text[before_end:a].strip()
        previous = [w.strip(_LEAD + _TRAIL + "()").lower() for w in head.split()[-3:]]
        following = text[raw_end : raw_end + 64].split()
        f = ["bias", "shape=" + shape(token)[:24], f"len={min(len(token), 24)}"]
        if _EMAIL.fullmatch(token):
            f.append("email")
        if _IP.fullmatch(token):
            f.append("ip" if all(int(p) < 256 for p in token.split(".")) else "dotted")
        digits = sum(c.isdigit() for c in token)
        f.append(f"digits={min(digits, 20)}")
        if digits == len(token):
            f.append(f"number={min(digits, 20)}")
        f += ["alpha"] * token.isalpha() + ["capital"] * token[0].isupper() + ["plus"] * token.startswith("+") + ["zero"] * token.startswith("0")
        f += ["key"] * ("=" in token) + ["closed"] * (y < raw_end) + ["opened"] * (x > a)
        for k, w in enumerate(reversed(previous)):
            if w in CUE_OF:
                f.append(f"cue{k}={CUE_OF[w]}")
        f.append("before:" + (shape(previous[-1])[:16] if previous and any(c.isdigit() for c in previous[-1]) else "word" if previous else "none"))
        if following and any(c.isdigit() for c in following[0]):
            f.append("after:" + shape(following[0].strip(_TRAIL))[:16])
        s.doc.append(doc)
        s.start.append(x)
        s.end.append(y)
        s.key.append(_key(token))
        s.linked.append(near)
        s.left.append(bool(previous) and not near)
        s.right.append(bool(following))
        s.features.append(f)
        if near and len(s.doc) > 1 and s.doc[-2] == doc:
            s.right[-2] = False
        before_end = raw_end if y == raw_end else -1  # signs behind a token end what it is part of
    cues: dict[str, tuple[list[int], set[str]]] = {}
    for i in range(first_site, len(s.doc)):
        of, seen = cues.setdefault(s.key[i], ([], set()))
        of.append(i)
        seen.update(x for x in s.features[i] if x.startswith("cue"))
    for of, seen in cues.values():
        if len(of) > 1:
            for i in of:
                s.features[i] += [f"any:{x}" for x in sorted(seen)]


def edges(s: Sites) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring sites, and pairs of each site that has others of its key and their hub; hubs are numbered behind the sites."""
    chain = [(i - 1, i) for i in range(1, len(s.doc)) if s.linked[i] and s.doc[i] == s.doc[i - 1]]
    groups: dict[tuple[int, str], list[int]] = {}
    for i, k in enumerate(zip(s.doc, s.key)):
        groups.setdefault(k, []).append(i)
    hubs = (g for g in groups.values() if len(g) > 1)
    skip = [(i, len(s.doc) + h) for h, g in enumerate(hubs) for i in g]
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


@dataclass
class Model:
    names: dict[str, int]
    unary: np.ndarray  # features, labels
    chain: np.ndarray  # label of the left, label of the right
    same: np.ndarray  # by kind, outside included: bonus of a site and its hub of equal kinds


def _structure() -> np.ndarray:
    """What may not follow: the inside of an entity anything but its kind."""
    out = np.zeros((K, K))
    for b in range(2, K, 2):
        out[:, b] = FORBIDDEN
        out[[b - 1, b], b] = 0
    return out


def skip_table(same: np.ndarray) -> np.ndarray:
    """Potential of a skip edge for two labels."""
    return np.where(KIND_OF[:, None] == KIND_OF[None], same[KIND_OF][:, None], 0.0)


def unaries(m: Model, s: Sites) -> np.ndarray:
    """Potentials of the sites' labels, those of observed neighbours included."""
    at, owner = [], []
    for i, f in enumerate(s.features):
        for x in f:
            k = m.names.get(x)
            if k is not None:
                at.append(k)
                owner.append(i)
    out = np.zeros((len(s.features), K))
    np.add.at(out, owner, m.unary[at])
    out[np.array(s.left, bool)] += m.chain[OUTSIDE]
    out[np.array(s.right, bool)] += m.chain[:, OUTSIDE]
    first = ~np.array(s.left, bool) & ~np.array(s.linked, bool)
    out[first] += _structure()[OUTSIDE]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def marginals(unary: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], rounds: int | None = None, damping: float = DAMPING, owner: np.ndarray | None = None) -> np.ndarray:
    """Loopy belief propagation. pairs: edges and the potential of their two labels; exact without cycles. Each owner's (document's)
    messages are passed until they settle, in at most so many rounds if these are given."""
    pairs = [(e, t) for e, t in pairs if len(e)]
    if not pairs:
        return _softmax(unary)
    src = np.concatenate([x for e, _ in pairs for x in (e[:, 0], e[:, 1])])
    dst = np.concatenate([x for e, _ in pairs for x in (e[:, 1], e[:, 0])])
    back = np.concatenate([x + off for off, n in zip(np.cumsum([0, *(2 * len(e) for e, _ in pairs)]), (len(e) for e, _ in pairs)) for x in (np.arange(n, 2 * n), np.arange(n))])
    tables = [t for _, tab in pairs for t in (np.exp(tab), np.exp(tab.T))]
    blocks = np.cumsum([0, *(len(e) for e, _ in pairs for _ in range(2))])
    of = (np.zeros(len(unary), np.int64) if owner is None else owner)[src]
    log = np.full((len(src), K), -np.log(K))
    belief = unary.copy()

    def gather(live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = live[np.argsort(dst[live], kind="stable")]
        return order, np.flatnonzero(np.concatenate([[True], dst[order][1:] != dst[order][:-1]]))

    every = np.arange(len(src))
    live, (order, heads) = every, gather(every)
    k = 0
    while len(live) and (rounds is None or k < rounds):
        nodes = dst[order][heads]
        belief[nodes] = unary[nodes] + np.add.reduceat(log[order], heads, axis=0)
        out = belief[src[live]] - log[back[live]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        cuts = np.searchsorted(live, blocks)
        new = np.concatenate([out[a:b] @ t for a, b, t in zip(cuts, cuts[1:], tables)])
        new = np.log(np.maximum(new / new.sum(axis=1, keepdims=True), 1e-300))
        keep = 1 - (1 - damping) * 0.98 ** max(k - CALM, 0)
        step = new if not k else (1 - keep) * new + keep * log[live]
        change = np.abs(np.exp(new if k < CALM else step) - np.exp(log[live])).max(axis=1)
        log[live] = step
        moving = np.zeros(of.max() + 1, bool)
        moving[of[live[change >= SETTLED]]] = True
        if not moving[of[live]].all():
            live = live[moving[of[live]]]
            if len(live):
                order, heads = gather(live)
        k += 1
    order, heads = gather(every)
    belief = unary.copy()
    belief[dst[order][heads]] += np.add.reduceat(log[order], heads, axis=0)
    return _softmax(belief)


def with_hubs(unary: np.ndarray, skip: np.ndarray, doc: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Potentials of sites and hubs, whose labels are kinds only, and the document of each."""
    hubs = int(skip[:, 1].max()) + 1 - len(unary) if len(skip) else 0
    owner = np.concatenate([np.array(doc, np.int64), np.zeros(hubs, np.int64)])
    owner[skip[:, 1]] = owner[skip[:, 0]]
    flat = np.zeros((hubs, K))
    flat[:, 2::2] = FORBIDDEN
    return np.concatenate([unary, flat]), owner


def label(m: Model, texts: list[str | None]) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, kind, least probability) of every entity."""
    s = Sites()
    for i in np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.string()), MAY_HAVE).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
        add_sites(s, i, texts[i])
    if not s.doc:
        return []
    chain, skip = edges(s)
    potentials, owner = with_hubs(unaries(m, s), skip, s.doc)
    p = marginals(potentials, [(chain, m.chain), (skip, skip_table(m.same))], owner=owner)[: len(s.doc)]
    best = p.argmax(axis=1)
    kind = p @ (KIND_OF[:, None] == np.arange(len(KINDS) + 1)[None])
    out: list[list] = []
    for i, y in enumerate(best.tolist()):
        if y == OUTSIDE:
            continue
        k = int(KIND_OF[y])
        goes_on = y % 2 == 0 and out and s.linked[i] and out[-1][5] == i - 1 and out[-1][3] == KINDS[k - 1]
        if goes_on:
            out[-1][2], out[-1][4], out[-1][5] = s.end[i], min(out[-1][4], kind[i, k]), i
        else:
            out.append([s.doc[i], s.start[i], s.end[i], KINDS[k - 1], float(kind[i, k]), i])
    return [(d, a, b, name, round(float(q), 4)) for d, a, b, name, q, _ in out]


def made(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Seeded documents and their entities: (start, end, kind)."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    syllables = "th er on an re ing ed en at ou st nd sch ein ver qui ment tion la el ci os ra de com io al is ß ñ é ü".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.randrange(1, 5)))
    name = lambda: " ".join(word().capitalize() + "a" for _ in range(rng.randrange(1, 3)))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    octet = lambda: str(rng.randrange(256))
    email = lambda: f"{pick([word(), word() + '.' + word(), word() + '.' + digits(2), word() + digits(3)])}@{pick([word(), 'mail' + digits(1)])}.{pick(['com', 'org', 'net', 'example.com', 'de'])}"
    phone = lambda: pick([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(2)} {digits(7)}", f"+{digits(2)}{digits(10)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])
    card = lambda: pick([digits(16), digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(15)])
    ident = lambda: pick([f"{digits(3)}-{digits(2)}-{digits(4)}", pick(["DE", "FR", "ES", "GB"]) + digits(20)])
    vague = lambda: digits(9)  # noqa: E731  an identifier only by its context
    plain = lambda: pick([digits(1), digits(2), str(rng.randrange(1900, 2100)), digits(1) + "." + digits(1), digits(1) + "." + digits(1) + ".", "version " + digits(1) + ".", digits(1) + "." + digits(1) + "." + digits(2), digits(3) + "," + digits(3), digits(5), digits(6), f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", digits(2) + "%", "token = \"" + hexa(40) + "\"", "password=" + hexa(18), "AKIA" + hexa(16).upper(), word() + digits(2), "https://" + word() + ".org/" + digits(4), "vol. " + digits(2), "page " + digits(3), digits(2) + "/" + digits(2) + "/" + digits(4), "@" + word(), "isbn " + digits(13)])
    out = []
    for _ in range(n):
        text, spans = "", []
        held = {"EMAIL": [email()], "PHONE": [phone()], "IP": [".".join(octet() for _ in range(4))], "CARD": [card()], "ID": [ident(), vague()], "NAME": [name()]}
        number = vague()  # a number that is none
        tail = pick(["", "", "", "", "!!", "%%%", "###", "***", " |"])
        named = told = False
        for _ in range(rng.randrange(5, 50)):
            r = rng.random()
            if r < 0.62:
                text += word() if rng.random() < 0.85 else word().capitalize()
            elif r < 0.74:
                text += plain()
            elif r < 0.76:
                text += pick(["item ", "order ", ""]) + number
            else:
                kind = pick(KINDS)
                value = pick(held[kind]) if rng.random() < 0.6 else {"EMAIL": email, "PHONE": phone, "IP": lambda: ".".join(octet() for _ in range(4)), "CARD": card, "ID": ident, "NAME": name}[kind]()
                cue = ""
                if kind == "NAME":
                    if value not in held["NAME"] or not named or rng.random() < 0.3:
                        cue = pick(["Mr. ", "Dr. ", "Frau ", "name: ", "Sra. ", "contact "])
                        named |= value in held["NAME"]
                    elif rng.random() < 0.5:
                        value = value.split()[-1]
                elif value == held["ID"][1]:
                    if not told or rng.random() < 0.4:
                        cue, told = pick(["ssn ", "id: ", "passport ", "tax id "]), True
                elif rng.random() < 0.3:
                    cue = pick({"EMAIL": ["email: ", "write "], "PHONE": ["call ", "tel: ", "phone "], "IP": ["ip ", "host ", "from "], "CARD": ["card ", "visa ", "credit card "], "ID": ["ssn ", "iban ", "id "]}[kind])
                text += cue
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            text += tail + pick([" ", " ", " ", " ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


def gold(s: Sites, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Labels of the sites of documents whose entities are known."""
    y = np.zeros(len(s.doc), np.int64)
    for i, (d, a, b) in enumerate(zip(s.doc, s.start, s.end)):
        for x, z, kind in spans[d]:
            if x <= a and b <= z + 1:
                y[i] = 1 + 2 * KINDS.index(kind) + (a > x)
    return y


@cache
def model(n: int = TRAINING, seed: int = SEED) -> Model:
    """Weights by pseudo-likelihood: each site's label given its features and the others' true labels. Made once in a process."""
    docs = made(n, seed)
    s = Sites()
    for i, (t, _) in enumerate(docs):
        add_sites(s, i, t)
    y = gold(s, [x for _, x in docs])
    count: dict[str, int] = {}
    for f in s.features:
        for x in f:
            count[x] = count.get(x, 0) + 1
    names = {x: k for k, x in enumerate(sorted(x for x, c in count.items() if c > 2))}
    owner, at = map(np.array, zip(*((i, names[x]) for i, f in enumerate(s.features) for x in f if x in names)))
    chain, skip = edges(s)
    m = Model(names, np.zeros((len(names), K)), _structure(), np.zeros(len(KINDS) + 1))
    truth, has = np.eye(K)[y], np.zeros((len(y), len(names)))
    has[owner, at] = 1
    left, right = np.array(s.left, bool), np.array(s.right, bool)
    first = ~left & ~np.array(s.linked, bool)
    # the true labels of the sites and the kind of the hub that each site is tied to
    before, behind, tied = np.zeros((len(y), K)), np.zeros((len(y), K)), np.zeros((len(y), len(KINDS) + 1))
    before[chain[:, 1]] = truth[chain[:, 0]]
    behind[chain[:, 0]] = truth[chain[:, 1]]
    before[left, OUTSIDE] = 1
    behind[right, OUTSIDE] = 1
    site, hub = skip[:, 0], skip[:, 1] - len(y)
    own = np.eye(len(KINDS) + 1)[KIND_OF[y[site]]]
    counted = np.zeros((hub.max() + 1, len(KINDS) + 1))
    np.add.at(counted, hub, own)
    tied[site, (counted[hub] - own).argmax(axis=1)] = 1  # the hub has the kind of most others
    kinds = (KIND_OF[:, None] == np.arange(len(KINDS) + 1)[None]).astype(float)
    held = [np.full(m.unary.shape, 1e-6), np.full((K, K), 1e-6), np.full(len(KINDS) + 1, 1e-6)]
    free = _structure() == 0
    for _ in range(STEPS):
        score = has @ m.unary + before @ m.chain + behind @ m.chain.T + (tied * m.same) @ kinds.T + np.outer(first, _structure()[OUTSIDE])
        error = (_softmax(score) - truth) / len(y)
        g = has.T @ error
        gc = before.T @ error + error.T @ behind
        gs = (tied * (error @ kinds)).sum(axis=0)
        for w, grad, h in zip((m.unary, m.chain, m.same), (g, gc * free, gs), held):
            grad = grad + DECAY * w * (1 if w is not m.chain else free)
            h += grad**2
            w -= RATE * grad / np.sqrt(h)
    return m


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, score (least marginal probability of the kind) of every entity."""
    held = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = label(held.value, strings(batch))
        if found:
            doc, a, b, kind, p = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind), pa.array(p, pa.float64())], names=["doc_id", "start", "end", "kind", "score"])

    return over(ids_and_texts(docs).where("text is not null"), "doc_id long, start long, end long, kind string, score double", run)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with [KIND] in place of each entity (n_chars follows, where it is a column); other columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = strings(batch)
        found = label(held.value, texts)
        for i, a, b, kind, _ in reversed(found):
            texts[i] = f"{texts[i][:a]}[{kind}]{texts[i][b:]}"
        if found:
            columns = {"text": pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            batch = replaced(batch, columns)
        yield batch

    return over(docs, docs.schema, run)
