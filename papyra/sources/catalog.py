"""The library's files and its stored catalog: what a scan finds, what changed, and what is kept."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The newest catalog format this engine reads, and the size of a page of unknown size.
FORMAT, PAGE_WIDTH, PAGE_HEIGHT = 2, 612.0, 792.0
ENTRY = "struct<path:string,mtime_ms:bigint,size:bigint,doi:string,arxiv:string,title:string,text_indexed:boolean>"
EAGER_PAGES = 64


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, mtime_ms, size) of the PDF files under root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path lies under one of a few configured roots, by whole components."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return inside


def schedule(scans: list[DataFrame]) -> DataFrame:
    """Paths to visit: those of all roots, once each where roots are nested."""
    paths = scans[0].select("path")
    for scan in scans[1:]:
        paths = paths.union(scan.select("path"))
    return paths.distinct()


def changes(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (path, change): unchanged files have the stored time and size. One shuffle of each side by path."""
    old = stored.select("path", F.struct("mtime_ms", "size").alias("old"))
    rows = files.select("path", F.struct("mtime_ms", "size").alias("new")).join(old, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return rows.select("path", change.alias("change"))


def upsert(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Entries after a scan: of each path the one of the latest epoch. Partial aggregation comes before the shuffle."""
    rows = stored.unionByName(scanned)
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "epoch").alias("e")).select("path", "e.*")


def catalog_entries(raw: Column) -> Column:
    """Array of entries in a stored catalog: an envelope of a known version or a bare array; none if newer or corrupt."""
    text = F.ltrim(raw)
    envelope = F.from_json(text, f"version int, entries array<{ENTRY}>")
    bare = F.from_json(text, f"array<{ENTRY}>")
    none = F.array().cast(f"array<{ENTRY}>")
    known = F.when(envelope["version"] <= FORMAT, envelope["entries"])
    return F.coalesce(F.when(F.startswith(text, F.lit("[")), bare).otherwise(known), none)


def page_size_estimates(pages: DataFrame) -> DataFrame:
    """Rows (doc, width, height): the upper median of the sizes of pages 0 to 63."""
    middle = lambda c: F.coalesce(F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int")))
    early = F.col("src") < EAGER_PAGES
    width, height = F.when(early, F.col("width")), F.when(early, F.col("height"))
    return pages.groupBy("doc").agg(F.coalesce(middle(width), F.lit(PAGE_WIDTH)).alias("width"), F.coalesce(middle(height), F.lit(PAGE_HEIGHT)).alias("height"))


def first_of_category(files: DataFrame, tokens: list[str]) -> DataFrame:
    """Rows (category, path, n) of files (path): each belongs to the first token that its name has, regardless of case; the
    first file by path stands for its category."""
    name, category = F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(None).cast("string")
    for t in reversed(tokens):
        category = F.when(F.contains(name, F.lit(t.lower())), t).otherwise(category)
    return files.withColumn("category", category).where(F.col("category").isNotNull()).groupBy("category").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def canonical_roots(roots: list[str]) -> list[str]:
    """Configured roots as they are known: existing folders alone, links resolved, once each, in order of name."""
    return sorted({os.path.realpath(r) for r in roots if os.path.isdir(r)})


def scanned_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Rows (path, mtime_ms, size) of regular PDF files below canonical roots, once each: links are left out, and so is what
    resolves to a place outside its root. The driver lists names; folders of a cluster's store are listed by pdf_files."""
    rows = {}
    for root in canonical_roots(roots):
        for folder, _, names in os.walk(root, followlinks=False):
            for name in names:
                path = os.path.join(folder, name)
                if name.lower().endswith(".pdf") and os.path.isfile(path) and not os.path.islink(path) and os.path.realpath(path).startswith(root.rstrip("/") + "/"):
                    mark = os.stat(path)
                    rows[path] = (path, mark.st_mtime_ns // 1_000_000, mark.st_size)
    return spark.createDataFrame([rows[p] for p in sorted(rows)], "path string, mtime_ms long, size long")
