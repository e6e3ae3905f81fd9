from papyra.plans.text_plans import size_formats


def test_half_a_byte_goes_to_the_even_number(spark, tmp_path):
    rows = [(0, 1382.5), (5, 1383.5), (1, 138.25), (10, 1381.5), (15, 0.5), (20, 1.5)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r["size"] for r in size_formats(spark, str(tmp_path)).collect()}
    assert got == {0: "1.3 KB", 5: "1.4 KB", 1: "1.3 KB", 10: "1.3 KB", 15: "0 B", 20: "2 B"}
