import json

from papyra.operators import layout, lookup, search
from papyra.sources import catalog
from papyra.streaming import queries as streams
from pyspark.sql import functions as F


def test_catalog_formats(spark):
    entry = {"path": "/a.pdf", "mtime_ms": 1, "size": 2}
    raws = [json.dumps({"version": 1, "entries": [entry]}), json.dumps([entry]), json.dumps({"version": 3, "entries": [entry]}), "{broken", "", None]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    sizes = {r["i"]: r["n"] for r in rows.select("i", F.size(catalog.catalog_entries(F.col("raw"))).alias("n")).collect()}
    assert sizes == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_changes_and_roots(spark):
    old = spark.createDataFrame([("/r/a", 1, 1), ("/r/b", 1, 1), ("/r/c", 1, 1)], "path string, mtime_ms long, size long")
    new = spark.createDataFrame([("/r/a", 1, 1), ("/r/b", 1, 2), ("/r2/d", 1, 1)], "path string, mtime_ms long, size long")
    assert {(r["path"], r["change"]) for r in catalog.changes(new, old).collect()} == {("/r/a", "unchanged"), ("/r/b", "changed"), ("/r/c", "removed"), ("/r2/d", "added")}
    assert [r["path"] for r in new.where(catalog.under(F.col("path"), ["/r"])).collect()] == ["/r/a", "/r/b"]


def test_pdf_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.pdf", "x/b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    assert sorted((r["path"].rsplit("/", 1)[1], r["size"]) for r in catalog.pdf_files(spark, str(tmp_path)).collect()) == [("a.pdf", 5), ("b.PDF", 5)]


def test_a_heading_closes_what_is_below_it(spark):
    kinds = ["point", "section", "environment", "point", "subsection", "point", "environment", "point", "section", "point"]
    rows = spark.createDataFrame([(1, i, k, i) for i, k in enumerate(kinds)], "doc int, at int, kind string, id int")
    got = {r["id"]: (r["section"], r["subsection"], r["environment"]) for r in lookup.contexts(rows).collect()}
    assert got == {0: (None, None, None), 3: (1, None, 2), 5: (1, 4, None), 7: (1, 4, 6), 9: (8, None, None)}


def test_duplicate_links_are_judged_against_kept_ones(spark):
    rows = spark.createDataFrame([(1, i, x, 0.0, 10.0, 10.0) for i, x in enumerate([0.0, 2.0, 4.0, 50.0])], "page int, i int, x double, y double, w double, h double")
    assert sorted(r["i"] for r in lookup.without_duplicates(rows, "page", "i").collect()) == [0, 2, 3]


def test_sample_indices(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (10,)], "n int")
    got = {r["n"]: r["s"] for r in rows.select("n", layout.sample_indices(F.col("n"), 4).alias("s")).collect()}
    assert got == {0: [], 1: [0], 3: [0, 1, 2], 10: [0, 3, 6, 9]}


def test_trigrams_admit_all_substrings(spark):
    text = "σ² ≤ ∇_M log q(x) — see §4.1 (Eq. 12), naïve ﬁle"
    queries = [text[a:b] for a in range(0, len(text), 3) for b in (a + 2, a + 5, a + 9)]
    row = spark.createDataFrame([(text,)], "t string").select(*[search.admits(F.col("t"), q).alias(f"q{i}") for i, q in enumerate([*queries, "absent"])]).first()
    assert list(row) == [True] * len(queries) + [False]
    assert len(search.trigram_bitmap([text, "", None])) == 4096


def test_bursts_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 'a'), (1, TIMESTAMP '2024-01-01 00:00:01', 'ab'), (1, TIMESTAMP '2024-01-01 00:01:00', 'b'), (1, TIMESTAMP '2024-01-01 01:00:00', 'late') t(who, ts, typed)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = streams.debounced(stream, "who", "5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted((r["typed"], r["n"]) for r in spark.table("bursts").collect()) == [("ab", 2), ("b", 1)]
    assert sorted(r["typed"] for r in streams.debounced(rows, "who", "5 seconds").collect()) == ["ab", "b", "late"]
