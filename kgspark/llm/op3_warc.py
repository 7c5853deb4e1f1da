"""WARC: a splittable reader of archives of gzip members, and a writer.

A split is a byte range of a file.  Its task scans for gzip's magic, takes a place as the
beginning of a member only if the gzip header is sound and what inflates from there begins
like a WARC record, and owns the members that begin inside the range, which it reads to
their end beyond it.  Behind a member the next one begins, or the scan goes on.  So no
index is needed, each record is read once, and splits can be as small as one likes.

A member whose payload is stored, not deflated, and is itself an archive has members inside that
look like those of the file.  A split that begins within it decodes the members from
LOOK_BACK bytes before on, and so knows where the outer one ends; only in an outer member that
begins still earlier the inner records are read as well.

A member that does not inflate to its end (cut off or damaged) has no records, and the
scan goes on behind its magic.  A member may hold several records; one whose block is
shorter than its Content-Length is not a record.  Missing headers are null.  Empty files
have no records, an empty table is one empty archive or none.  The writer leaves out the
headers of null columns, drops line ends and outer blanks of URIs, and marks a null body by a header, so null and empty stay apart.
Rows that repeat are records of their own.  Of a table the writer takes the three columns that it
is given; others cannot clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, qualified, shared_dir

MAGIC, BEGINS = b"\x1f\x8b\x08", b"WARC/1."
SPLIT, PIECE, FEED, BATCH, LOOK_BACK = 32 << 20, 1 << 20, 1 << 14, 4 << 20, 2 << 20
RECORDS = "file string, offset long, record_id string, uri string, type string, content_type string, payload binary"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
NO_BODY = "X-Null-Body"


class _Window:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, source: pa.NativeFile, at: int, size: int) -> None:
        self.source, self.base, self.size, self.data = source, at, size, bytearray()

    def more(self) -> bool:
        left = self.size - self.base - len(self.data)
        if left <= 0:
            return False
        self.source.seek(self.base + len(self.data))
        self.data += self.source.read(min(PIECE, left))
        return True

    def get(self, at: int, n: int) -> bytearray:
        """At most n bytes at the place, fewer at the end of the file."""
        while at + n > self.base + len(self.data) and self.more():
            pass
        return self.data[at - self.base : at - self.base + n]

    def find(self, what: bytes, at: int, before: int) -> int:
        """The first place from at on that is less than before; -1 if there is none."""
        while True:
            k = self.data.find(what, at - self.base, before - self.base + len(what) - 1)
            if k >= 0:
                return self.base + k
            if self.base + len(self.data) >= before + len(what) - 1 or not self.more():
                return -1

    def forget(self, at: int) -> None:
        if at - self.base > PIECE:
            del self.data[: at - self.base]
            self.base = at


def inflate(w: _Window, at: int) -> tuple[bytes, int] | None:
    """What the member at this place holds and where it ends; None if none of WARC records is there."""
    head = bytes(w.get(at, 10))
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return None
    z, parts, held = zlib.decompressobj(31), [], 0
    place = at
    while not z.eof:
        piece = w.get(place, FEED)
        if not len(piece):
            return None
        try:
            part = z.decompress(piece)
        except zlib.error:
            return None
        place += len(piece)
        parts.append(part)
        held += len(part)
        if len(parts) > 1 and held >= len(BEGINS) > held - len(part):
            parts = [b"".join(parts)]
        if held >= len(BEGINS) and not parts[0].startswith(BEGINS):
            return None
    whole = b"".join(parts)
    return (whole, place - len(z.unused_data)) if whole.startswith(BEGINS) else None


def records(member: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by names in small letters, and blocks of a member's records."""
    at = 0
    while member.startswith(BEGINS, at):
        end = member.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = member[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if not length.isdecimal() or end + 4 + int(length) > len(member):
            return
        at = end + 4 + int(length)
        yield headers, member[end + 4 : at]
        while member.startswith(b"\r\n", at):
            at += 2


def _begin(source: pa.NativeFile, start: int) -> int:
    """Where a split's scan begins: its start, or the end of a member that begins up to LOOK_BACK bytes before and reaches beyond."""
    at = max(0, start - LOOK_BACK)
    w = _Window(source, at, source.size())
    while at < start and (at := w.find(MAGIC, at, start)) >= 0:
        got = inflate(w, at)
        at = at + 1 if got is None else got[1]
        w.forget(at)
    return max(at, start)


def read_split(path: str, start: int, end: int) -> Iterator[tuple]:
    """Rows of RECORDS of the members that begin in [start, end)."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as source:
        at = _begin(source, start)
        w = _Window(source, at, source.size())
        while at < end and (at := w.find(MAGIC, at, end)) >= 0:
            got = inflate(w, at)
            if got is None:
                at += 1
                continue
            for h, block in records(got[0]):
                body = None if h.get(NO_BODY.lower()) else block
                yield path, at, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-type"), h.get("content-type"), body
            at = got[1]
            w.forget(at)


def read(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """RECORDS of the files (URIs; a folder stands for its .warc.gz files), by splits of so many bytes."""
    files = []
    for path in paths:
        fs, name = pafs.FileSystem.from_uri(path)
        info = fs.get_file_info(name)
        scheme = path[: path.index(":") + 3] if "://" in path else "file://"
        found = fs.get_file_info(pafs.FileSelector(name, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files += [(scheme + i.path, i.size) for i in found if i.is_file and i.size and (i.path.endswith(".warc.gz") or len(found) == 1)]
    total = sum(-(-size // split) for _, size in files)
    splits = spark.createDataFrame(files, "path string, size long").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for row in read_split(path, start, start + split):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return splits.repartition(max(1, min(total, 100_000))).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def member(record_id: str | None, uri: str | None, body: bytes | None, content_type: str = "text/html", level: int = 1) -> bytes:
    """One record as a gzip member."""
    head = [b"WARC/1.0", b"WARC-Type: resource", b"WARC-Date: 2026-01-01T00:00:00Z"]
    for key, value in (("WARC-Record-ID", record_id), ("WARC-Target-URI", uri)):
        if value is not None:
            head.append(f"{key}: {value}".replace("\r", "").replace("\n", "").encode())
    if body is None:
        head.append(f"{NO_BODY}: 1".encode())
    block = body or b""
    head += [f"Content-Type: {content_type}".encode(), b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(rows: DataFrame, folder: str, record_id: Column, uri: Column, body: Column) -> list[str]:
    """An archive for each partition, in the folder; the files' URIs. Each attempt of a task writes a file of its own, and only those of tasks that ended are named."""

    def run(batches: Batches) -> Batches:
        fs, name = pafs.FileSystem.from_uri(folder)
        fs.create_dir(name, recursive=True)
        own, n = f"{uuid.uuid4()}.warc.gz", 0
        with fs.open_output_stream(f"{name}/{own}", compression=None) as out:
            for batch in batches:
                for i, u, b in zip(*(batch.column(c).to_pylist() for c in ("record_id", "uri", "body"))):
                    out.write(member(i, u, b))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([own] if n else [], pa.string())], names=["file"])

    picked = rows.select(record_id.cast("string").alias("record_id"), uri.cast("string").alias("uri"), body.cast("binary").alias("body"))
    return [f"{folder.rstrip('/')}/{r.file}" for r in picked.mapInArrow(run, "file string").collect()]


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """page_id, url, html, as they come back from archives of the pages in the shared folder."""
    spark = pages.sparkSession
    folder = f"{qualified(spark, shared_dir(spark))}/warc-{uuid.uuid4()}"
    files = write(pages, folder, F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.col("url"), F.col("html"))
    number = F.regexp_extract("record_id", r"^<urn:page:(-?[0-9]+)>$", 1)
    return read(spark, files, split).select(F.when(number != "", number.cast("long")).alias("page_id"), F.col("uri").alias("url"), F.decode("payload", "UTF-8").alias("html"))


ROUND_TRIP_SQL = "SELECT page_id, url, html FROM pages"
