"""The analyzers of functions.text over batches of texts at once, as arrays, for tasks in Python."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are looked at together: their arrays stay in a core's cache.
SLICE = 1 << 19
_GONE = 255


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@cache
def _factors(n: int) -> np.ndarray:
    """An odd factor for each place of a word."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


@cache
def _bare(folds: tuple[str, str]) -> np.ndarray:
    """What becomes of a lower-case character: a letter or digit of ASCII, 0 where words end, _GONE for a mark; the last stands for all beyond."""
    out = np.zeros(0x2001, np.uint8)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out[ord(c)] = ord(c)
    for a, b in zip(*folds):
        out[ord(a)] = out[ord(b)]
    out[0x300:0x370] = _GONE
    return out


@cache
def _lettered() -> np.ndarray:
    """Whether a character is a letter, a number or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)])


@dataclass(frozen=True)
class Found:
    """The different words of each text, by text and then by first place: the text's number, the word's hash, how often it occurs, its rank there."""

    row: np.ndarray
    word: np.ndarray
    freq: np.ndarray
    rank: np.ndarray
    start: np.ndarray  # of its first place among the bytes of data
    end: np.ndarray
    data: pa.Buffer

    def terms(self, which: np.ndarray | None = None) -> pa.Array:
        """The words themselves, or those of the given places, which ascend."""
        s, e = (self.start, self.end) if which is None else (self.start[which], self.end[which])
        if not len(s):
            return pa.array([], pa.string())
        cuts = np.empty(2 * len(s), np.int32)
        cuts[0::2], cuts[1::2] = s, e
        return pa.StringArray.from_buffers(2 * len(s) - 1, pa.py_buffer(cuts), self.data).take(pa.array(np.arange(0, 2 * len(s) - 1, 2)))


def per_row(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending numbers the places where each begins, and which of these runs each belongs to."""
    new = np.concatenate((np.ones(min(len(found), 1), bool), found[1:] != found[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


class Words:
    """Words of lower-case texts: with folds runs of a-z and 0-9 after folding, else runs of letters, numbers and marks; of two characters or more, that
    are not in stop."""

    def __init__(self, folds: tuple[str, str] | None = None, stop: frozenset[str] = frozenset()):
        self.folds, self.stop = folds, sorted(stop)

    def __getstate__(self) -> dict:
        return {"folds": self.folds, "stop": self.stop}

    def hashes(self, words: list[str]) -> np.ndarray:
        """The hash of each of these words (as they come out of texts), whatever stop says."""
        if not words:
            return np.empty(0, np.uint64)
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(length) - length
        codes[first + length - 1] = 0
        return np.add.reduceat(codes * _factors(1 << int(length.max()).bit_length())[np.arange(len(codes)) - np.repeat(first, length)], first)

    def _stops(self) -> np.ndarray:
        if "held" not in self.__dict__:
            self.held = np.sort(self.hashes(self.stop))
        return self.held

    def found(self, texts: list[str]) -> Found:
        """The words of texts."""
        joined = "\n".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(length) - length
        if self.folds:
            bare = _bare(self.folds)[np.minimum(codes, 0x2000)]
            if (bare == _GONE).any():
                kept = np.flatnonzero(bare != _GONE)
                bare, begins = bare[kept], np.searchsorted(kept, begins)
            inside, codes, data, at = bare != 0, bare, pa.py_buffer(bare), None
        else:
            inside, data = _lettered()[codes], pa.py_buffer(joined.encode("utf-8", "surrogatepass"))
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        steps = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        if not len(start):
            none = np.empty(0, np.int64)
            return Found(none, none.astype(np.uint64), none, none, none, none, data)
        last = np.repeat(start, np.diff(np.append(start, len(codes))))
        off = np.arange(start[0], len(codes)) - last
        off[~inside[start[0] :]] = 0
        value = np.where(inside, codes, 0)[start[0] :].astype(np.uint64) * _factors(1 << int((end - start).max()).bit_length())[off]
        word = np.add.reduceat(value, start - start[0])
        long = end - start > 1
        start, end, word = start[long], end[long], word[long]
        row = np.searchsorted(begins, start, "right") - 1
        different, code = np.unique(word, return_inverse=True)
        if len(self.stop) and len(word):
            stops = self._stops()
            here = np.minimum(np.searchsorted(stops, different), len(stops) - 1)
            told = (stops[here] != different)[code]
            start, end, word, row, code = start[told], end[told], word[told], row[told], code[told]
        _, first, freq = np.unique(row * max(len(different), 1) + code, return_index=True, return_counts=True)
        order = np.argsort(first)
        first, freq = first[order], freq[order]
        row = row[first]
        runs, of = per_row(row)
        rank = np.arange(len(row)) - (runs[of] if len(row) else 0)
        start, end = start[first], end[first]
        return Found(row, word[first], freq, rank, *((start, end) if at is None else (at[start], at[end])), data)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, Found]]:
        """Of a column of texts, slice by slice: the number of its first row, and its words. Null texts have none."""
        some, first, chars = [], 0, 0
        for k, t in enumerate(texts.to_pylist()):
            some.append(t or "")
            chars += len(some[-1])
            if chars >= SLICE:
                yield first, self.found(some)
                some, first, chars = [], k + 1, 0
        if some:
            yield first, self.found(some)
