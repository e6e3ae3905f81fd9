"""Windows and folds over the pages and rows of one document at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stack(pages: DataFrame, padding: int, gap: int) -> DataFrame:
    """Adds top: pages (doc, src, height) lie below each other."""
    before = W.partitionBy("doc").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("top", padding + F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0)))


def columns(runs: DataFrame, gap: Column) -> DataFrame:
    """Merges the spans (page, low, high) of each page that overlap or lie less than gap apart: rows (page, low, high, n)."""
    order = W.partitionBy("page").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("low") - reach >= gap), 1).otherwise(0)
    island = runs.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy("page", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).drop("island")


def tiles(size: DataFrame, key: str, tile: int, across: Callable = lambda x, w: F.lit(True), down: Callable = lambda y, h: F.lit(True)) -> DataFrame:
    """Tiles (key, x, y, w, h) of pictures (key, width, height), the last of a row or column cut. Others than those for which
    across(x, w) and down(y, h) hold, conditions on columns of the picture too, are not made."""
    cut = lambda c, at: F.least(F.lit(tile), F.col(c) - at)
    steps = lambda c, keep: F.filter(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1, F.lit(tile))).otherwise(F.array().cast("array<int>")), lambda at: keep(at, cut(c, at)))
    grid = size.select("*", F.explode(steps("height", down)).alias("y")).select("*", F.explode(steps("width", across)).alias("x"))
    return grid.select(key, "x", "y", cut("width", F.col("x")).alias("w"), cut("height", F.col("y")).alias("h"))


def nested(headings: DataFrame) -> DataFrame:
    """Adds parent: of a heading (doc, id, depth) of depth 1 the last one of depth 0 before it; without one it is a root."""
    before = W.partitionBy("doc").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return headings.withColumn("parent", F.when(F.col("depth") == 1, F.last(F.when(F.col("depth") == 0, F.col("id")), ignorenulls=True).over(before)))


def first_of_each(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group. Spark ranks within a partition before the shuffle, so no group arrives whole."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def recent(opened: DataFrame, owner: str, k: int) -> DataFrame:
    """Of each owner the k paths opened last, once each, the latest first: rows (owner, path, opened, rank)."""
    latest = opened.groupBy(owner, "path").agg(F.max("opened").alias("opened"))
    return first_of_each(latest, owner, [F.desc("opened"), F.col("path")], k)


def within_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Pages (doc, src, cost) that fit: those before the first at which the document's running cost exceeds the budget."""
    upto = W.partitionBy("doc").orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("spent", F.sum("cost").over(upto)).where(F.col("spent") <= budget)


def stale_jobs(jobs: DataFrame) -> DataFrame:
    """Adds stale to jobs (doc, seq, stamp, bump): whether the document's generation, which bumps raise, is past the job's stamp."""
    now = jobs.groupBy("doc").agg(F.sum(F.col("bump").cast("long")).alias("generation"))
    return jobs.join(now, "doc").withColumn("stale", F.col("stamp") < F.col("generation")).drop("generation")


def latest_result(results: DataFrame, key: str) -> DataFrame:
    """Of each key the result of the highest sequence number; what was superseded is dropped."""
    rest = [c for c in results.columns if c not in (key, "seq")]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.max("seq").alias("seq")).select(key, "seq", "r.*")


def sample_indices(total: Column, limit: int) -> Column:
    """Evenly spaced indices, the first and the last among them; all where there are no more than limit."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (total - 1) / float(max(limit - 1, 1)) + 0.5).cast("int"))
    every = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(total <= limit, every).otherwise(F.array_distinct(spread))


def restored_session(raw: Column) -> Column:
    """Struct of tabs (paths) and active out of a stored session: entries that are no tabs are left out, what is torn is empty."""
    path = lambda t: F.try_variant_get(t, "$.path", "string")
    whole = F.try_parse_json(raw)
    kind = lambda v, p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    tabs = F.when(F.startswith(kind(whole, "$.tabs"), F.lit("ARRAY")), F.try_variant_get(whole, "$.tabs", "array<variant>"))
    tabs = F.filter(F.coalesce(tabs, F.array().cast("array<variant>")), lambda t: F.coalesce(kind(t, "$.path") == "STRING", F.lit(False)))
    active = F.when(kind(whole, "$.activePath") == "STRING", F.try_variant_get(whole, "$.activePath", "string"))
    return F.struct(F.transform(tabs, path).alias("tabs"), active.alias("active"))
