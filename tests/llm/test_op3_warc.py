import os
import random

import pytest
from kgspark.llm import op3_warc as op
from pyspark.sql import functions as F


def archive(path, rng, n=60):
    bodies = [None if i == 3 else b"" if i == 4 else rng.randbytes(rng.randrange(1, 3000)) + (op.MAGIC + b"\x00" * 7) * (i % 3) for i in range(n)]
    data = b"".join(op.member(f"<urn:page:{i}>", f"http://x/{i}", b) for i, b in enumerate(bodies))
    path.write_bytes(b"junk" + op.MAGIC + b"no member" + data)
    return bodies


@pytest.mark.parametrize("split", [1 << 30, 5000, 333, 64])
def test_every_record_once_whatever_the_splits(tmp_path, split):
    bodies = archive(f := tmp_path / "a.warc.gz", random.Random(1))
    size = os.path.getsize(f)
    rows = [r for s in range(0, size, split) for r in op.read_split(f"file://{f}", s, s + split)]
    assert [(r[2], r[6]) for r in rows] == [(f"<urn:page:{i}>", b) for i, b in enumerate(bodies)]


def test_damage_is_skipped(tmp_path):
    f = tmp_path / "a.warc.gz"
    a, b, c = (op.member(str(i), None, os.urandom(500)) for i in range(3))
    f.write_bytes(a + b[:200] + c + a[:-9])
    assert [r[2] for r in op.read_split(f"file://{f}", 0, 1 << 20)] == ["0", "2"]


def test_member_of_several_records():
    import zlib

    z = lambda m: zlib.decompress(m, 31)
    both = z(op.member("a", None, b"x\r\n\r\n")) + z(op.member("b", None, b""))
    assert [(h["warc-record-id"], block) for h, block in op.records(both)] == [("a", b"x\r\n\r\n"), ("b", b"")]


def test_spark_reader_and_folder(spark, tmp_path):
    bodies = archive(tmp_path / "a.warc.gz", random.Random(2))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = op.read(spark, [f"file://{tmp_path}"], split=700).orderBy("offset").collect()
    assert [r.payload and bytes(r.payload) for r in rows] == [b or b for b in bodies]


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (None, None, "é漢🎉"), (2, "", None), (3, "http://b/", ""), (4, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("payload", F.lit(1))
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or "")
    assert sorted(map(tuple, op.round_trip(pages, split=1000).collect()), key=key) == sorted(rows, key=key)
    assert op.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1 << 30, 4000, 100])
def test_archives_within_members_are_payload(tmp_path, split):
    rng = random.Random(4)
    inner = b"".join(op.member(f"inner-{i}", None, rng.randbytes(900)) for i in range(4))
    outer = [op.member("a", None, rng.randbytes(700)), op.member("b", None, inner, level=0), op.member("c", None, b"x"), op.member("d", None, inner[:950], level=0), op.member("e", None, b"y")]
    (f := tmp_path / "a.warc.gz").write_bytes(b"".join(outer))
    size = os.path.getsize(f)
    rows = [r[2] for s in range(0, size, split) for r in op.read_split(f"file://{f}", s, s + split)]
    assert rows == ["a", "b", "c", "d", "e"]
