"""Exact search against all products in whole numbers."""

import math
import random

import pytest

from papyra.llm.topk import top_k


def plain(rows, k=5, every=50):
    live = []
    for i, vec in rows:
        if i is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        live.append((i, [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256.0 * x) for x in vec]))
    found = {}
    for i, a in live:
        if i % every == 0:
            found.setdefault(i, []).extend((-sum(x * y for x, y in zip(a, b)), j) for j, b in live if j != i)
    return sorted((i, r + 1, j, -s) for i, own in found.items() for r, (s, j) in enumerate(sorted(own)[:k]))


def searched(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(v, i, 1, b"") for i, v in rows], "embedding array<double>, vec_id long, rank int, v binary").repartition(parts)
    return sorted(tuple(r) for r in top_k(df, "vec_id", "embedding", **options).collect())


def test_ties_nulls_repeats_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(3, rows[3][1]), (50, rows[7][1]), (50, rows[50][1]), (None, [1.0] * 6), (600, None), (601, [None] * 6), (602, [math.nan] * 6), (603, [math.inf] * 6), (650, []), (604, [9.0] * 9), (-50, [1.0])]
    assert searched(spark, rows) == plain(rows)
    assert searched(spark, rows, query_block=2, k=3) == plain(rows, k=3)


def test_large_components_are_kept(spark):
    rows = [(i, [float(i), 1.0]) for i in range(60)] + [(100, [2e6, 1.0]), (101, [-3e6, 5.0]), (150, [1.5e6, -2.0]), (102, [1e7, 0.0])]
    assert searched(spark, rows) == plain(rows)
    wide = [(0, [1e300, 0.0]), (1, [0.0, 1e300]), (2, [0.0, 3.5])]
    assert searched(spark, wide) == plain(wide)


def test_scores_far_below_the_best_do_no_harm(spark):
    rows = [(0, [1e12]), (1, [-1e12])] + [(k, [float(k)]) for k in range(2, 9)]
    assert searched(spark, rows, parts=6) == plain(rows)


def test_a_score_beyond_a_long_raises(spark):
    with pytest.raises(Exception):  # noqa: B017
        searched(spark, [(0, [1e18]), (1, [1e18])])


def test_large_random_table(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    assert searched(spark, rows, parts=5) == plain(rows)


def test_few_rows(spark):
    assert searched(spark, [], 1) == [] and searched(spark, [(50, [1.0])], 1) == [] and searched(spark, [(1, [1.0])], 1) == []
    assert searched(spark, [(50, [1.0]), (1, [2.0])], 1) == [(50, 1, 1, 256 * 512)]
