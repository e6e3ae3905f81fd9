"""Media: lossless storage against recomputed values, pages with several references, and HTML that leaves out tags."""

import hashlib
import struct
import zlib

import corpus
import pytest

from papyra.llm import media


def unpacked(png):
    """Samples of a PNG by its format: all IDAT data, filter 0 rows."""
    at, body = 8, b""
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        if png[at + 4 : at + 8] == b"IHDR":
            width, height = struct.unpack(">II", png[at + 8 : at + 16])
        if png[at + 4 : at + 8] == b"IDAT":
            body += png[at + 8 : at + 8 + n]
        at += 12 + n
    raw = zlib.decompress(body)
    return b"".join(raw[r * (3 * width + 1) + 1 : (r + 1) * (3 * width + 1)] for r in range(height))


def test_every_document_comes_back(spark):
    docs = corpus.edge_documents()
    df = spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA).repartition(3)
    got = media.media_of_documents(df).collect()
    want = []
    for i, text, *_ in docs:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        png = media.to_png(payload)
        assert unpacked(png) == payload
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), 0, f"{len(data)} bytes"))
    rows = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.position, r.caption) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 and None not in v for v in by_text.values())


def test_empty_table(spark):
    assert media.media_of_documents(spark.createDataFrame([], corpus.SCHEMA)).count() == 0


def seen(html):
    return [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parse_html(html)]


def test_tags_that_html_lets_one_leave_out():
    assert seen("<head><title>no</title><p>yes</p><p>two") == [("text", "yes", None), ("text", "two", None)]
    assert seen("<html><head><meta charset=x>shown") == [("text", "shown", None)]
    assert seen("<figure><img src=a><figcaption>cap</figure><p>after") == [("image", "a", "cap"), ("text", "after", None)]
    assert seen("<figure><figcaption>first</figcaption><img src=a><img src=b alt=c></figure>") == [("image", "a", "first"), ("image", "b", "first")]
    assert seen("<figure><img src=a><figcaption>cap<section>text</section>") == [("image", "a", "cap"), ("text", "text", None)]
    assert seen("<figure><img src=a alt=in><figure><img src=b><figcaption>in b</figcaption></figure><figcaption>out</figcaption></figure>") == [("image", "a", "out"), ("image", "b", "in b")]
    assert seen("<script>var a='</p>'</script>x<style>y</style></p></figure></figcaption>") == [("text", "x", None)]
    assert seen(None) == seen("") == []


def test_pages_of_several_references_keep_order_captions_and_payloads(spark):
    pages = []
    for p in range(30):
        body = "".join(f"<p>text {k}</p><figure><img src='sha256:{(p + k) % 5}' alt=''><figcaption>cap {p}.{k}</figcaption></figure>" for k in range(p % 4))
        pages.append((p, f"<html><body>{body}<p>end", "mine"))
    df = spark.createDataFrame([*pages, (90, None, "x"), (90, None, "x")], "page_id int, html string, digest2 string")
    store = spark.createDataFrame([(str(d), f"payload {d}") for d in range(4)], "digest string, payload string")
    from pyspark.sql import functions as F

    items = media.interleave(df, F.col("html")).select("page_id", F.inline("items"))
    assert items.where("page_id = 90").count() == 0
    refs = items.where("ref is not null").withColumn("digest", F.regexp_replace("ref", "^sha256:", ""))
    got = media.resolve(refs.select("page_id", "position", "caption", "digest"), store).collect()
    want = [(p, 2 * k + 1, f"cap {p}.{k}", str((p + k) % 5), f"payload {(p + k) % 5}" if (p + k) % 5 < 4 else None) for p in range(30) for k in range(p % 4)]
    assert sorted((r.page_id, r.position, r.caption, r.digest, r.payload) for r in got) == sorted(want)


def test_taken_names_raise(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="items"):
        media.interleave(spark.createDataFrame([("x", 1)], "html string, items int"), F.col("html"))
    with pytest.raises(ValueError, match="both"):
        media.resolve(spark.createDataFrame([("x", 1)], "digest string, a int"), spark.createDataFrame([("x", 1)], "digest string, a int"))
