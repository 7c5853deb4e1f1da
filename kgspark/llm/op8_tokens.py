"""Token counts attributed to sections by offsets.

A whole document is encoded once by a byte-level BPE.  Its tokens' bytes, one after the
other, are the text, so cumulated lengths are the tokens' offsets; these are joined to
the sections' intervals.  Sections are lines, each ending behind its line feed, or, of
a document made of several columns, these fields; together they are the whole text.

A token that lies in more than one section counts in one of them, by rule: "first" (where
it begins), "last" (where it ends) or "most" (where most of its bytes lie, the earlier
section of equal ones).  Sections' tokens hence add up to the document's.

Null texts have no rows; an empty text is one section of no tokens.  Rows that repeat are
each counted.  A null doc_id stays null.  Strings of special tokens are ordinary text.  A
null or empty field has no tokens; a document whose fields are all null has no rows.  An empty
table gives an empty result; columns that are not asked for are not read and cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, over, strings
from .words import chunks

#: A file of ranks (a base64 token and its rank a line) and the pattern that cuts texts before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RULES = ("first", "last", "most")
NAMES = ["doc_id", "section", "char_start", "char_end", "tokens", "crossing"]


@cache
def encoding(ranks: bytes, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and each token's number of bytes; made once in a process."""
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(held.values()) + 1, np.int64)
    for token, rank in held.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=held, special_tokens={}), sizes


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token [start, end) the section it counts in, and whether it crosses a boundary. sections: where they begin, ascending."""
    first = np.searchsorted(sections, start, side="right") - 1
    last = np.searchsorted(sections, end - 1, side="right") - 1
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    chosen = first.copy()
    for k in np.flatnonzero(crosses):
        cuts = np.concatenate([[start[k]], sections[first[k] + 1 : last[k] + 1], [end[k]]])
        chosen[k] = first[k] + int(np.diff(cuts).argmax())
    return chosen, crosses


def counted(texts: list[str], enc: tiktoken.Encoding, sizes: np.ndarray, rule: str, starts: list[list[int]] | None = None) -> tuple[np.ndarray, ...]:
    """Index of the text, section, char_start, char_end, tokens and crossing tokens, of every section. starts: bytes at which each text's sections
    begin, the first at 0; else sections are lines."""
    data = [t.encode() for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids = np.concatenate([np.asarray(enc.encode_to_numpy(t, disallowed_special=()), np.int64) for t in texts])
    end = np.cumsum(sizes[ids])
    assert (end[-1] if len(end) else 0) == begin[-1], "the tokens are not the text"
    buf = np.frombuffer(b"".join(data), np.uint8)
    if starts is None:
        behind = np.flatnonzero(buf == 10) + 1
        behind = behind[~np.isin(behind, begin)]  # a text's last line feed opens no section
        at = np.concatenate([begin[:-1], behind])
        doc = np.concatenate([np.arange(len(texts)), np.searchsorted(begin, behind, side="right") - 1])
        order = np.lexsort((doc, at))
        at, doc = at[order], doc[order]
    else:
        at = np.concatenate([begin[k] + np.array(x, np.int64) for k, x in enumerate(starts)])
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
    chosen, crosses = allocate(end - sizes[ids], end, at, rule)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    section = np.arange(len(at)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
    until = np.concatenate([at[1:], begin[-1:]])
    zero = chars[begin[doc]]
    return doc, section, chars[at] - zero, chars[until] - zero, np.bincount(chosen, minlength=len(at)), np.bincount(chosen[crosses], minlength=len(at))


def _held(docs: DataFrame, vocabulary: str, rule: str) -> Broadcast:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:  # the driver alone needs the file
        return docs.sparkSession.sparkContext.broadcast(f.read())


def sections(docs: DataFrame, vocabulary: str, rule: str = "most", pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, char_start, char_end, tokens, crossing (those of its tokens that reach into another section) of every line."""
    held = _held(docs, vocabulary, rule)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(held.value, pattern)
        ids = batch.column("doc_id")
        for at, piece in chunks(strings(batch)):
            doc, *rest = counted(piece, enc, sizes, rule)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + doc)), *(pa.array(x.astype(np.int64)) for x in rest)], names=NAMES)

    return over(ids_and_texts(docs).where("text is not null"), ", ".join(f"{n} long" for n in NAMES), run)


def fields(docs: DataFrame, columns: list[str], vocabulary: str, rule: str = "most", separator: str = "\n\n", pattern: str = PATTERN) -> DataFrame:
    """doc_id, field, char_start, char_end, tokens, crossing of every field of the documents that the columns make, joined by the separator, which
    belongs to the field before it."""
    held = _held(docs, vocabulary, rule)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(held.value, pattern)
        rows = [[(t or "") + separator * (k + 1 < len(columns)) for k, t in enumerate(r)] for r in zip(*(batch.column(k + 1).to_pylist() for k in range(len(columns))))]
        names = pa.array(columns)
        for at, piece in chunks(["".join(r) for r in rows]):
            starts = [np.cumsum([0, *(len(t.encode()) for t in r[:-1])]).tolist() for r in rows[at : at + len(piece)]]
            doc, field, *rest = counted(piece, enc, sizes, rule, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + doc)), names.take(pa.array(field)), *(pa.array(x.astype(np.int64)) for x in rest)], names=["doc_id", "field", *NAMES[2:]])

    some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    picked = docs.where(some).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"field_{k}") for k, c in enumerate(columns)))
    return over(picked, "doc_id long, field string, " + ", ".join(f"{n} long" for n in NAMES[2:]), run)
