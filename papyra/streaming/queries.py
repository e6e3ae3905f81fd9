"""Streams of keystrokes and pages; each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(keys: DataFrame, owner: str, quiet: str, lateness: str = "1 minute") -> DataFrame:
    """The last event (owner, ts, ..) of each burst that `quiet` ends. On a stream, bursts come out in append mode."""
    rest = [c for c in keys.columns if c not in (owner, "ts")]
    burst = keys.withWatermark("ts", lateness).groupBy(owner, F.session_window("ts", quiet))
    return burst.agg(F.max(F.struct("ts", *rest)).alias("last"), F.count("*").alias("n")).select(owner, "last.*", "n")


def indexing_progress(pages: DataFrame) -> DataFrame:
    """Of each document the pages indexed so far and their characters: complete or update mode on a stream."""
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum(F.char_length("raw").cast("long")).alias("chars"))
