from papyra.plans.view_plans import visible_tiles


def test_tiles_in_view_without_a_join(spark, tmp_path):
    parts = [(k, k * 7 % 51) for k in range(0, 4000, 37)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df, want = visible_tiles(spark, str(tmp_path)), set()
    for k, size in parts:
        width, height, vx, vy = size * 200, size * 150 + 7, k % 3000, k % 2000 - 500
        x0, y0, x1, y1 = max(0, vx - 768), max(0, vy - 768), min(width, vx + 1568), min(height, vy + 1368)
        for x in range(0, width, 1024):
            for y in range(0, height, 1024):
                w, h = min(1024, width - x), min(1024, height - y)
                if x1 > 0 and x0 < width and y1 > 0 and y0 < height and x + w >= x0 and x <= x1 and y + h >= y0 and y <= y1:
                    want.add((k, x, y, w, h))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
