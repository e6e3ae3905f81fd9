from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from papyra.functions import text as tx
from papyra.sources import store


def test_sidecars_are_moved_and_written_once(spark, tmp_path, monkeypatch):
    """Documents replaced, with fewer pages too, added and deleted; others stay, those without a path too. One write each."""
    root, writes, plain = f"{tmp_path}/sidecars", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: writes.append(path) or plain(self, path, *a, **b))
    pages = lambda rows: tx.with_search_text(spark.createDataFrame([(p, 1, 2, n, t) for p, n, t in rows], "path string, mtime_ms long, size long, src int, raw string"), breaks=True)
    first = [(f"/d{i}", n, f"T{i} {n}") for i in range(300) for n in range(3)] + [(None, 0, "x")]
    store.write_sidecars(pages(first), root)
    store.write_sidecars(pages([("/d1", 0, "New"), ("/d2", 0, "A"), ("/d2", 1, "B"), ("/new", 0, "N")]), root)
    gone = ["/d2", "/d7", "/none"]
    store.delete_sidecars(spark.createDataFrame([(p,) for p in gone], "path string"), root)
    assert len(writes) == 3
    want = {(p, n, t) for p, n, t in first if p not in ("/d1", "/d2", "/d7")} | {("/d1", 0, "New"), ("/new", 0, "N")}
    got = spark.read.parquet(root)
    assert sorted(map(str, {tuple(r) for r in got.select("path", "src", "text").collect()})) == sorted(map(str, want)) and got.count() == len(want)
    assert got.where((F.col("bucket") != F.pmod(F.xxhash64("path"), F.lit(store.BUCKETS))) | (F.col("folded") != F.lower("text"))).count() == 0


def test_a_bucket_without_documents_goes_and_others_are_not_touched(spark, tmp_path):
    root = f"{tmp_path}/sidecars"
    rows = spark.createDataFrame([(f"/d{i}", 1, 2, 0, "t") for i in range(5)], "path string, mtime_ms long, size long, src int, raw string")
    store.write_sidecars(tx.with_search_text(rows, breaks=True), root)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "sidecars").glob("bucket=*/*.parquet")}
    own = spark.read.parquet(root).where("path = '/d0'").first().bucket
    alone = spark.read.parquet(root).where(F.col("bucket") == own).count() == 1
    store.delete_sidecars(spark.createDataFrame([("/d0",)], "path string"), root)
    assert (tmp_path / "sidecars" / f"bucket={own}").exists() != alone
    assert all(f.stat().st_mtime_ns == t for f, t in before.items() if f.parent.name != f"bucket={own}")
    assert spark.read.parquet(root).count() == 4
