from decimal import ROUND_HALF_UP, Decimal

from papyra.plans.text_plans import size_formats


def to_fixed(n):
    """The reference's formatSize: toFixed takes the larger of two nearest values."""
    if n < 1024:
        return f"{n} B"
    value, unit = Decimal(n) / 1024, 0
    while value >= 1024 and unit < 2:
        value, unit = value / 1024, unit + 1
    return f"{value.quantize(Decimal('0.1') if value < 10 else Decimal(1), ROUND_HALF_UP)} {('KB', 'MB', 'GB')[unit]}"


def test_sizes_at_ties_have_rows(spark, tmp_path):
    sizes = [0, 1023, 1024, 1280, 1279, 1281, 1792, 10188, 10189, 10239, 10240, 10752, 11776, 11775, 2**20 - 1, 2**20, 5 * 2**18, 21 * 2**19, 2**30 - 1, 5 * 2**28, 25 * 2**30 // 2]
    rows = [(5 * i, float(n)) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r["size"] for r in size_formats(spark, str(tmp_path)).collect()}
    assert got == {5 * i: to_fixed(n) for i, n in enumerate(sizes)}
    assert got[15] == "1.3 KB"
