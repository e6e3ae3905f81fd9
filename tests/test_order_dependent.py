"""Queries without SQL whose result depends on order: spans, strokes, links and preview texts against plain loops."""

import math
import random

from pyspark.sql import functions as F

from papyra.functions import formats
from papyra.operators import lookup, structure, view


def test_spans_begin_earlier_over_free_ink(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(200):
        text = "".join(rng.choice("ab ") for _ in range(20))
        start, claimed = rng.randint(0, 19), sorted(rng.sample(range(20), rng.randint(0, 4)))
        rows.append((i, text, start, claimed))
        best = at = start
        while at > max(0, start - 6) and at - 1 not in claimed:
            at -= 1
            best = at if text[at] != " " else best
        want[i] = best
    df = spark.createDataFrame(rows, "id int, text string, start int, claimed array<int>")
    assert {r.id: r.s for r in df.select("id", formats.span_start(F.col("text"), F.col("start"), F.col("claimed")).alias("s")).collect()} == want


def test_strokes_keep_points_far_from_the_last_kept(spark):
    rng, rows, want = random.Random(2), [], {}
    for i in range(60):
        points = [(rng.random() * 4, rng.random() * 4) for _ in range(rng.randint(0, 15))]
        kept = []
        for p in points:
            if not kept or math.dist(p, kept[-1]) > 1.2:
                kept.append(p)
        rows.append((i, points))
        want[i] = kept
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    assert {r.id: [tuple(p) for p in r.k] for r in df.select("id", view.decimated(F.col("points")).alias("k")).collect()} == want


def test_links_stay_unless_one_kept_covers_them(spark):
    rng, rows, want = random.Random(3), [], set()

    def iou(a, b):
        w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w * h > 0 else 0.0

    for page in range(30):
        kept = []
        for n in range(12):
            box = (rng.random() * 3, rng.random() * 3, 5 + rng.random(), 5 + rng.random())
            rows.append((page, n, *box))
            if not any(iou(k, box) > 0.60 for k in kept):
                kept.append(box)
                want.add((page, n))
    df = spark.createDataFrame(rows, "page int, n int, x double, y double, w double, h double")
    assert {(r.page, r.n) for r in lookup.without_duplicates(df, "page", "n").collect()} == want


def test_preview_texts_join_the_runs_of_a_crop(spark):
    crops = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x double, y double, w double, h double")
    runs = spark.createDataFrame([(1, 3, "c", 9.0, 9.0, 5.0, 5.0), (1, 1, "a", 0.0, 0.0, 1.0, 1.0), (1, 2, "out", 10.0, 0.0, 1.0, 1.0)] + [(2, k, "xy", 0.0, 0.0, 1.0, 1.0) for k in range(900)], "page int, start int, text string, x double, y double, w double, h double")
    got = {r.page: r.text for r in structure.preview_texts(crops, runs, "page").collect()}
    assert got[1] == "a c" and got[2] == ("xy " * 900)[:400]
