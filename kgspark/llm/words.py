"""Vectorised words: texts become numpy arrays of word spans and 64-bit word hashes.

A word is a maximal run of letters, numbers and marks, lower-cased character by
character; ideographs, kana and Thai letters are words of their own.  Hashes are
polynomial sums modulo 2**64 taken from prefix sums, so neither words nor windows
of words are ever materialised as Python strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

U64 = np.uint64
_CHAR_P, _CHAR_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WORD_P, _WORD_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_TABLE = 0x20000
#: Characters that are tokenised together; one text may be longer.
CHUNK_CHARS = 100_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.zeros(_TABLE + 1, np.uint32)
    for c in range(_TABLE):
        if unicodedata.category(chr(c))[0] in "LNM":
            lower[c] = ord(chr(c).lower()[0])
    alone = np.zeros(_TABLE + 1, bool)
    for a, b in ((0x0E01, 0x0E30), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        alone[a : b + 1] = True
    alone &= lower > 0
    alone[_TABLE], lower[_TABLE] = True, 1
    return lower, alone


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_CHARS + 1024), base, U64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def window_hash(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that begin at these words."""
    return mix((sums[at + n] - sums[at]) * powers(_WORD_INV, len(sums))[at] + U64(n))


@dataclass
class Words:
    """Words of several texts; spans count characters from the text's own beginning."""

    n: int  # texts
    doc: np.ndarray  # index of the text, ascending
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text: index of its first word; one more at the end
    prefix: np.ndarray | None = None  # hash of the first characters of the word

    def sums(self) -> np.ndarray:
        """Prefix sums from which window_hash() takes the hash of any window."""
        sums = np.zeros(len(self.hash) + 1, U64)
        np.cumsum(self.hash * powers(_WORD_P, len(self.hash)), out=sums[1:])
        return sums

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the first words of all n-word windows, and the windows' hashes."""
        k = len(self.hash)
        if k < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: k - n + 1] == self.doc[n - 1 :])
        return at, window_hash(self.sums(), at, n)


def tokenize(texts: list[str], prefix: int = 0) -> Words:
    """Words of the texts; with prefix, also a hash of each word's first so many characters."""
    lower, alone = _tables()
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])
    cp = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
    if cp.size and cp.max() >= _TABLE:
        high = cp >= _TABLE
        word = (cp < 0x40000) & high
        low = lower[np.where(high, 0, cp)]
        low = np.where(word, cp, low)
        single = alone[np.where(high, 0, cp)] | word
    else:
        low, single = lower[cp], None
    inside = low > 0
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    if single is None and alone_any(cp):
        single = alone[cp]
    if single is None:
        at = np.flatnonzero(edge)
        start, end = at[::2], at[1::2]
    else:
        prev_in = np.concatenate(([False], inside[:-1]))
        prev_single = np.concatenate(([False], single[:-1]))
        start = np.flatnonzero(inside & (~prev_in | single | prev_single))
        next_in = np.concatenate((inside[1:], [False]))
        next_single = np.concatenate((single[1:], [False]))
        end = np.flatnonzero(inside & (~next_in | single | next_single)) + 1
    n = len(cp)
    sums = np.zeros(n + 1, U64)
    np.cumsum(low.astype(U64) * powers(_CHAR_P, n), out=sums[1:])
    inverse = powers(_CHAR_INV, n)[start] if len(start) else np.zeros(0, U64)
    hashes = mix((sums[end] - sums[start]) * inverse)
    short = None
    if prefix:
        short = mix((sums[np.minimum(end, start + prefix)] - sums[start]) * inverse + U64(prefix))
    first = np.searchsorted(start, begin)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    base = begin[doc]
    return Words(len(texts), doc, start - base, end - base, hashes, first, short)


def alone_any(cp: np.ndarray) -> bool:
    """Whether any character could be a word of its own."""
    return bool(cp.size) and bool(((cp >= 0x0E01) & ((cp <= 0x0E30) | (cp >= 0x3041))).any())


def chunks(texts: list[str | None], most: int = CHUNK_CHARS, most_texts: int = 512) -> Iterator[tuple[int, list[str]]]:
    """Consecutive pieces of the list of about so many characters: index of the first, texts. None is read as empty."""
    at, size, piece = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if piece and (size + len(t) > most or len(piece) >= most_texts):
            yield at, piece
            at, size, piece = i, 0, []
        piece.append(t)
        size += len(t)
    if piece:
        yield at, piece


def words_of(text: str | None) -> list[str]:
    """The text's words as lower-case strings."""
    w = tokenize([text or ""])
    lower, _ = _tables()
    return ["".join(chr(lower[ord(c)]) if ord(c) < _TABLE else c for c in text[a:b]) for a, b in zip(w.start.tolist(), w.end.tolist())]
