from papyra.plans.edit_plans import annotations_changed

SCHEMA = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_tax double"


def test_of_rows_with_a_key_the_first_in_the_file_counts(spark, tmp_path):
    """Readers take large files first, so the second one comes before the first there; a null is no value."""
    part = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    part([(1, 2, "A", None, 0.1), (1, 2, "A", 10.0, 0.1), (2, 2, "A", 10.0, 0.1), (3, 2, "A", 5.0, 0.1)], "a")
    part([(k, 2, "B", x, 0.2) for k, x in ((1, 5.0), (2, 5.0), (3, 10.0), *((k, 10.0) for k in range(4, 3000)))], "b")
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        (file,) = (tmp_path / name).glob("part-*.parquet")
        file.rename(tmp_path / "lineitem.parquet" / f"part-{name}.parquet")
    got = {r.doc: r.changed for r in annotations_changed(spark, str(tmp_path)).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [False, False, True, False]
