"""WARC: the contract, splits of any size, whole headers, several records a member, and damage."""

import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papyra.llm import warc


def plain(pages):
    first = {}
    for i, html, _ in pages:
        body = (html or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, html, _ in pages:
        body = (html or "").encode()
        again = body in first and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out)


def number(c):
    return F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).cast("long")


@pytest.mark.parametrize("split", [64 << 20, 997, 150])
def test_round_trip_at_any_split(spark, tmp_path, split):
    rng = random.Random(1)
    blobs = [rng.choice(["<p>é</p>", ""]) + "".join(rng.choice("abc \n\x1f\x8b\x08") for _ in range(n)) for n in (0, 5, 90, 100, 101, 4000, 70_000)]
    pages = [(i, rng.choice([None, *blobs]), rng.choice([None, f"http://a.example/é?{i}", ""])) for i in range(120)]
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, html string, url string, digest string").repartition(3)
    warc.write_archives(df, path, "page_id", "html", "url")
    rows = warc.resolved(warc.read_archives(spark, path, split_bytes=split))
    got = rows.select(number("record_id").alias("i"), "payload_bytes", "digest", "record_type", number("refers_to").alias("r")).collect()
    assert sorted(map(tuple, got)) == plain(pages)


def test_null_and_repeated_keys_keep_every_row(spark, tmp_path):
    body = "z" * 200
    pages = [(None, body, "u1"), (None, body, "u2"), (5, body, None), (5, body, None), (3, None, "v"), (3, None, "v")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, html string, url string"), path, "page_id", "html", "url")
    rows = warc.resolved(warc.read_archives(spark, path)).collect()
    assert len(rows) == 6 and {r.payload_bytes for r in rows} == {0, 200}
    assert sum(r.record_type == "revisit" for r in rows) >= 2
    assert all(r.refers_to.startswith("urn:row:5:") for r in rows if r.record_type == "revisit")


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, html string, url string"), path, "page_id", "html", "url")
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


def raw(n, body, first="Content-Type: application/http; msgtype=response\r\nX-Long: " + "q" * 300):
    return f"WARC/1.0\r\n{first}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def records(data, start=0, end=None, **options):
    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    return [r[0] for r in warc.records(File(), len(data), start, len(data) if end is None else end, **options)]


def test_long_headers_and_several_records_a_member():
    one = gzip.compress(raw(1, b"a" * 50))
    many = gzip.compress(raw(2, b"b") + raw(3, b"") + raw(4, os.urandom(3000)))
    data = one + many + gzip.compress(raw(5, b"e"))
    assert records(data) == [f"urn:x:{n}" for n in range(1, 6)]
    for step in (37, 200, 1000):
        assert [r for a in range(0, len(data), step) for r in records(data, a, a + step)] == [f"urn:x:{n}" for n in range(1, 6)]


def test_damage_raises_or_is_counted():
    good = [gzip.compress(raw(n, os.urandom(2000))) for n in range(3)]
    torn = good[0] + good[1][:-700]
    with pytest.raises(ValueError, match="damaged"):
        records(torn)
    assert records(torn, damaged="report") == ["urn:x:0", "urn:x:1"]
    bad = bytearray(good[1])
    bad[-300] ^= 0xFF
    bad[-6] ^= 0xFF
    got = records(good[0] + bytes(bad) + good[2], damaged="report")
    assert got[0] == "urn:x:0" and got[-1] == "urn:x:2" and len(got) == 3


def test_magic_within_bytes_is_no_record():
    junk = zlib.compress(b"x" * 50)
    data = gzip.compress(raw(1, warc.MAGIC * 400 + junk)) + gzip.compress(warc.MAGIC * 50) + gzip.compress(raw(2, b"z"))
    assert records(data) == ["urn:x:1", "urn:x:2"]


def test_many_records_of_all_sizes_come_once_and_in_order():
    rng = random.Random(4)
    rows = [{"record_type": "response", "record_id": f"urn:row:{i}", "payload": bytes(rng.choices(b"abcdef<> ", k=rng.choice([0, 1, 63, 64, 100, 3000, 20_000]))), "payload_digest": "0", "target_uri": None, "refers_to": None} for i in range(400)]
    data = b"".join(map(warc.member, rows))
    assert records(data) == [r["record_id"] for r in rows]
    for step in (1000, 40_000):
        assert [x for a in range(0, len(data), step) for x in records(data, a, a + step)] == [r["record_id"] for r in rows]
