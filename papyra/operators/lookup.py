"""Joins between documents, entries, points and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions.geometry import iou, overlap

SAME_LINK = 0.60


def resolve(citations: DataFrame, library: DataFrame) -> DataFrame:
    """Citations (scheme, value, ..) with path and title of the entry that has the identifier; of several, the first path.

    The library is reduced to one row an identifier before the join, so a common identifier makes no pairs.
    """
    ids = library.select("path", "title", F.explode(F.create_map(F.lit("doi"), "doi", F.lit("arxiv"), "arxiv")).alias("scheme", "value"))
    first = ids.where(F.col("value").isNotNull()).groupBy("scheme", "value").agg(F.min(F.struct("path", "title")).alias("hit"))
    return citations.join(first, ["scheme", "value"], "left").select(*citations.columns, "hit.path", "hit.title")


def contexts(rows: DataFrame) -> DataFrame:
    """As-of join in one pass: rows (doc, at, kind, id) of kinds section, subsection, environment and point.

    Each point gets the ids of the last section, subsection and environment at or before it; a heading closes deeper
    levels and the environment. At equal places entries come before points.
    """
    before = W.partitionBy("doc").orderBy("at", F.col("kind") == "point", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda *kinds: F.last(F.when(F.col("kind").isin(*kinds), F.struct("kind", "id")), ignorenulls=True).over(before)
    known = rows.select("*", last("section").alias("s"), last("section", "subsection").alias("b"), last("section", "subsection", "environment").alias("e"))
    pick = lambda c, kind: F.when(F.col(f"{c}.kind") == kind, F.col(f"{c}.id")).alias(kind)
    return known.where("kind = 'point'").select("doc", "id", pick("s", "section"), pick("b", "subsection"), pick("e", "environment"))


def covered(runs: DataFrame, quads: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Runs of which at least `share` of the area lies in one of the quads of their page."""
    q = quads.select(key, *[F.col(c).alias(f"q{c}") for c in "xywh"])
    area = overlap(F.col("x"), F.col("w"), F.col("qx"), F.col("qw")) * overlap(F.col("y"), F.col("h"), F.col("qy"), F.col("qh"))
    return runs.alias("r").join(q.alias("q"), (F.col(f"r.{key}") == F.col(f"q.{key}")) & (area >= share * F.col("w") * F.col("h")), "left_semi")


def without_duplicates(links: DataFrame, page: str, order: str) -> DataFrame:
    """Links in order, without those that an earlier kept one of the page covers with IoU above 0.60. A page's links are one row."""
    held = links.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(order, "x", "y", "w", "h"))).alias("links"))
    none = F.array().cast(held.schema["links"].dataType)
    box = lambda c: {k: c[k] for k in "xywh"}
    kept = F.aggregate("links", none, lambda a, n: F.when(F.exists(a, lambda k: iou(box(k), box(n)) > SAME_LINK), a).otherwise(F.concat(a, F.array(n))))
    return held.select(page, F.explode(kept).alias("l")).select(page, "l.*")


def visible_pages(layout: DataFrame, view: DataFrame, overscan: float) -> DataFrame:
    """First and last page (doc, first, last) that meets each document's viewport (doc, scroll, view_h), widened by overscan."""
    rows = layout.join(view, "doc")
    meets = (F.col("top") <= F.col("scroll") + F.col("view_h") + overscan) & (F.col("top") + F.col("height") >= F.col("scroll") - overscan)
    return rows.where(meets).groupBy("doc").agg(F.min("src").alias("first"), F.max("src").alias("last"))


def page_at(layout: DataFrame, y: Column) -> DataFrame:
    """The page of each document that holds y; a gap belongs to the next page, and the ends hold what lies beyond them."""
    bottom = F.col("top") + F.col("height")
    return layout.groupBy("doc").agg(F.coalesce(F.min(F.when(bottom >= y, F.col("src"))), F.max("src")).alias("page"))
