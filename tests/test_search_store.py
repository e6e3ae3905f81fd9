"""Normalisation and search by the plain definition, the stored index, sidecars, catalog and replacement."""

import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import validate
from papyra.operators import search
from papyra.sources import catalog, store

WHITE = {chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
QUOTES = dict.fromkeys("‘’‚′", "'") | dict.fromkeys("“”„″", '"')


def plain(raw):
    """Normalised characters, each with the raw index it comes from."""
    out, space = [], True
    for i, c in enumerate(raw):
        if c in WHITE:
            if not space:
                out.append((" ", i))
            space = True
        else:
            space = False
            out += [(x, i) for x in QUOTES.get(c) or unicodedata.normalize("NFKC", c)]
    return out


def raggeds(n=300, seed=1):
    rng = random.Random(seed)
    pool = ["a", "b", "tion", "Tion", " ", "  ", "\t", "\n", "\x85", "\xa0", " ", "　", "ﬁ", "²", "’", "“", "İ", "Σ", "é", "ÿ", "\x00", "①", "㍍"]
    return [None, "", " ", "abc ", "abc\x85", "\xa0abc", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def test_normalize_and_offsets():
    for raw in raggeds():
        if raw is None:
            continue
        text, breaks = tx.normalize(raw)
        want = plain(raw)
        assert text == "".join(c for c, _ in want), raw
        assert [tx.raw_index(breaks, i) for i in range(len(text))] == [i for _, i in want], raw
        assert all(a[1] != b[1] and a[0] < b[0] for a, b in zip(breaks, breaks[1:], strict=False))


def test_both_ways_of_search_text_agree(spark):
    pages = spark.createDataFrame([(i, r) for i, r in enumerate(raggeds())], "id int, raw string")
    for r in tx.with_search_text(pages, breaks=True).collect():
        text, breaks = tx.normalize(r.raw or "")
        assert (r.normalized, r.folded) == (text, tx.fold(text)), r.raw
        assert [tx.raw_index([tuple(b) for b in r.breaks], i) for i in range(len(text))] == [tx.raw_index(breaks, i) for i in range(len(text))], r.raw


@pytest.mark.parametrize("query", ["tion", "a tion", "Tion  ", "fi", "'", "m"])
def test_matches_carry_raw_places(spark, query):
    raws = [r for r in raggeds(seed=7)]
    pages = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raws)], "doc int, src int, raw string")
    may = pages.where(tx.may_hold(F.col("raw"), tx.prepare_query(query)))
    got = {(r.doc, r.start, r.len) for r in search.match_rows(tx.with_search_text(may), query).collect()}
    want = set()
    for i, raw in enumerate(raws):
        chars = plain(raw or "")
        hay, needle = tx.fold("".join(c for c, _ in chars)), tx.prepare_query(query)
        at = hay.find(needle)
        while at >= 0:
            first, last = chars[at][1], chars[at + len(needle) - 1][1]
            want.add((i, first, last - first + 1))
            at = hay.find(needle, at + len(needle))
    assert got == want


def test_hits_have_pages_under_the_documents_limit(spark):
    pages = [(f"/l/{d}", f"{d}.pdf", s, "xy " * (s % 7)) for d in range(5) for s in range(12)]
    df = tx.with_search_text(spark.createDataFrame(pages, "path string, name string, src int, raw string"))
    rows = search.library_hits(df, "xy", documents=3).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3] and {r.path for r in rows} == {"/l/0", "/l/1", "/l/2"}
    for r in rows:
        found = [(p.src, len(p.matches)) for p in r.pages]
        assert r.total == 20 and sum(n for _, n in found) == 20 and found == sorted(found) and found[0] == (1, 1)


def test_candidates_lose_no_document(spark):
    rng = random.Random(3)
    texts = [(i, None if i % 50 == 7 else "".join(rng.choice("abcd é") for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(texts, "slot long, folded string")
    stored, always = store.gram_index(spark, docs), docs.where("folded IS NULL")
    for q in ["abcd", "a bc", "dcba é", "ab cd abc", "zzzz", "abc", "éab"]:
        kind, found = search.gram_candidates(*stored, always, q)
        holds = {i for i, t in texts if t is None or q in t}
        assert found is None or holds <= {r.slot for r in found.collect()}, q
        assert (kind == "unknown") == (found is None)
    assert {r.slot for r in search.gram_candidates(*stored, always, "zzzz")[1].collect()} == {i for i, t in texts if t is None}


def test_trigram_bitmaps_admit_what_is_there(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("aB1 é,\n") for _ in range(40))) for i in range(60)]
    bits = search.trigram_bitmaps(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    for q in ["ab1", "b 1a", "é,a", "zzz", "ab"]:
        got = {r.id for r in bits.where(search.bitmap_admits(F.col("bits"), q)).collect()}
        assert {i for i, t in texts if any(q.lower() in page.lower() for page in t.split("\n"))} <= got
        assert q != "zzz" or not got


def test_index_bytes_round_trip_and_refuse_damage():
    data = store.index_bytes(2**64 - 1, ["/a/é.pdf", "/b"], {5: [0, 1], 9: None, 2**32 - 2: [1]}, [1])
    assert store.index_of_bytes(data) == (2**64 - 1, ["/a/é.pdf", "/b"], {5: [0, 1], 9: None, 2**32 - 2: [1]}, [1])
    assert all(store.index_of_bytes(data[:n]) is None for n in range(len(data)))
    assert store.index_of_bytes(b"\x00" * len(data)) is None and store.index_of_bytes(data[:4] + b"\x02" + data[5:]) is None
    far = bytearray(store.index_bytes(0, [], {5: [0]}, []))
    far[28] = 9  # the list's start
    assert store.index_of_bytes(bytes(far)) is None
    assert store.index_of_bytes(store.index_bytes(0, [], {}, [])) == (0, [], {}, [])


def test_signature_knows_no_order(spark):
    files = spark.createDataFrame([(f"/é/{i}", i * 10**9, i) for i in range(40)], "path string, mtime_ms long, size long")
    one = store.signature(files).first().signature
    assert one == store.signature(files.orderBy(F.desc("path"))).first().signature != store.signature(files.limit(39)).first().signature
    want = sum(store.fnv(f"/é/{i}".encode()) ^ ((i * 10**9 << 17) % 2**64 | i * 10**9 >> 47) ^ ((i << 31) % 2**64 | i >> 33) for i in range(40)) % 2**64
    assert int(one) == want and store.fnv(b"") == 0xCBF29CE484222325


def test_replacing_keeps_the_old_table_on_failure(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(target)
    with pytest.raises(ValueError):
        store.replace_verified(spark.range(9), target, lambda t: False)
    assert spark.read.parquet(target).count() == 3

    def stop():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.replace_verified(spark.range(9), target, lambda t: True, stop)
    assert spark.read.parquet(target).count() == 3
    store.replace_verified(spark.range(9), target, lambda t: t.count() == 9)
    assert spark.read.parquet(target).count() == 9 and sorted(os.listdir(tmp_path)) == ["t"]


def test_scans_skip_links_and_what_leaves_the_root(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    (root / "sub").mkdir(parents=True)
    out.mkdir()
    for p in (root / "a.pdf", root / "sub" / "B.PDF", root / "c.txt", out / "d.pdf"):
        p.write_bytes(b"x")
    os.symlink(out / "d.pdf", root / "link.pdf")
    os.symlink(out, root / "linked")
    rows = catalog.scanned_files(spark, [str(root), str(root / "sub"), str(tmp_path / "none"), str(root / "a.pdf")]).collect()
    assert [os.path.relpath(r.path, root) for r in rows] == ["a.pdf", "sub/B.PDF"] and rows[0]["size"] == 1
    assert catalog.canonical_roots([str(tmp_path / "none")]) == []


@pytest.mark.parametrize("text", ["3\n", "3\x85", "3 ", "a\n", "2-1", "0", "1-", "1234567"])
def test_line_ends_are_no_part_of_a_token_or_range(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(validate.is_page_range(F.col("t")).alias("r"), validate.is_safe_token(F.col("t")).alias("s"), validate.pages_in_range(F.col("t"), F.lit(9)).alias("p"), validate.page_jump(F.col("t"), F.lit(9)).alias("j")).first()
    assert not row.r and row.p is None
    assert row.s == (text.isascii() and "\n" not in text and not text.startswith("-"))
