"""Command palette: fuzzy scores of titles, sections of ranked rows, and what is used most.

Scores come from one Arrow-batched kernel, once for each different title; all else is joins, windows and small top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.operators.folds import Fold, fold

#: What a match earns and loses, and how far it may spread.
PREFIX, WORD_START, CONSECUTIVE, CHAR, GAP_START, GAP_EXTEND, LEADING, MOST_SPREAD, LEAST_SPAN = 1000, 60, 20, 8, 6, 2, 1, 6, 16
#: What a keyword match counts, what is noise beside the best, and the rows of a section.
KEYWORD, WEAK, PER_GROUP, RECENT, TRACKED = 0.6, 0.4, 5, 4, 60
#: The order of sections that no score decides.
GROUPS = ["Recent", "Sections", "Environments", "Tabs", "Navigate", "File", "Edit", "Tools", "Page", "View", "Panels", "Search", "Settings"]


#: Characters, with what fills rows up, that the kernel takes at a time.
CELLS = 1 << 17


def subsequence_scores(texts: list[str], query: str) -> list[float | None]:
    """Of each text the best alignment of the query's characters, in order, regardless of case; None if there is none.

    Texts of like length are scored together, a row each of one table of characters.
    """
    if not query:
        return [0.0] * len(texts)
    needle, out, rest = query.lower(), [None] * len(texts), []
    for i, text in enumerate(texts):
        hay = text.lower()
        if hay.startswith(needle):
            out[i] = PREFIX + 200 / (1 + len(text))
        elif len(hay) >= len(needle):
            rest.append((len(hay), i, hay))
    rest.sort()
    while rest:
        n = CELLS // rest[-1][0] or 1  # the longest first: they say how wide the table is
        rest, some = rest[:-n], rest[-n:]
        for (_, i, _), found in zip(some, aligned([hay for _, _, hay in some], needle), strict=True):
            out[i] = found
    return out


def aligned(hays: list[str], needle: str) -> list[float | None]:
    """A row of best scores by end position for each query character: a match follows its neighbour, or the best end two or
    more places back, less a cost that grows with the gap. With `best[k] + GAP_EXTEND * k` that is one running maximum.
    """
    n, m = max(map(len, hays)), len(needle)
    chars = np.array(hays, dtype=f"<U{n}").view("<u4").reshape(len(hays), n).astype(np.int64)
    at = np.arange(n)
    chars[at >= np.array([len(h) for h in hays])[:, None]] = -1  # beyond a text's end
    bound = np.ones(chars.shape, dtype=bool)
    bound[:, 1:] = np.isin(chars[:, :-1], [ord(c) for c in " -&("])
    earned = CHAR + WORD_START * bound

    def shifted(x: np.ndarray, by: int, fill: float) -> np.ndarray:
        moved = np.full(x.shape, fill, dtype=x.dtype)
        moved[:, by:] = x[:, :-by]
        return moved

    hit = chars == ord(needle[0])
    best, start = np.where(hit, -LEADING * at + earned, -np.inf), np.where(hit, at, -1)
    for c in needle[1:]:
        tilted = shifted(best + GAP_EXTEND * at, 2, -np.inf)
        top = np.maximum.accumulate(tilted, axis=1)
        newer = tilted > shifted(top, 1, -np.inf)
        newer[:, 0] = True
        source = np.maximum.accumulate(np.where(newer, at, 0), axis=1)  # where the running maximum comes from, the first of equals
        far = top - GAP_START - GAP_EXTEND * (at - 2)
        near = shifted(best + CONSECUTIVE, 1, -np.inf)
        follows = (near > -np.inf) & (near >= far)
        begins = np.where(follows, shifted(start, 1, -1), np.take_along_axis(start, np.maximum(source - 2, 0), axis=1))
        live = (chars == ord(c)) & (follows | (far > -np.inf))
        best, start = np.where(live, np.where(follows, near, far) + earned, -np.inf), np.where(live, begins, -1)
    end = best.argmax(axis=1)
    rows = np.arange(len(hays))
    score, span = best[rows, end], end - start[rows, end] + 1
    none = (score == -np.inf) | ((span > m * MOST_SPREAD) & (span > LEAST_SPAN))
    return [None if lost else x for lost, x in zip(none.tolist(), score.tolist(), strict=True)]


def subsequence_score(text: str, query: str) -> float | None:
    return subsequence_scores([text], query)[0]


def best_of(title: float | None, keywords: list[float | None]) -> float | None:
    """The title's score or a keyword's, which counts less and never as a prefix."""
    found = [title, *(None if s is None else min(s, PREFIX - 1) * KEYWORD for s in keywords)]
    return max((s for s in found if s is not None), default=None)


def match_score(title: str, keywords: list[str] | None, query: str) -> float | None:
    return best_of(subsequence_score(title, query), subsequence_scores(list(keywords) if keywords is not None else [], query))


def score(title: Column, keywords: Column, query: str) -> Column:
    """Column form of match_score. Each different text of a batch is scored once, all of them together."""

    @F.pandas_udf("double")
    def run(titles: pd.Series, words: pd.Series) -> pd.Series:
        rows = [(t, () if w is None or t is None else tuple(w)) for t, w in zip(titles, words, strict=True)]
        texts = list({x for t, w in rows if t is not None for x in (t, *w)})
        known = dict(zip(texts, subsequence_scores(texts, query), strict=True))
        return pd.Series([None if t is None else best_of(known[t], [known[k] for k in w]) for t, w in rows], dtype="float64")

    return run(title, keywords)


def usage_boost(uses: Column) -> Column:
    return F.when(F.coalesce(uses, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(40.0), F.log2(uses + 1.0) * 12))


def numbered(sections: DataFrame) -> DataFrame:
    """Adds position to rows of sections (section, rank): draw order across all of them, from 0. They are few: top-k of groups."""
    return sections.withColumn("position", F.row_number().over(W.orderBy("section", "rank")) - 1)


def ranked_sections(candidates: DataFrame, query: str, per_group: int = PER_GROUP) -> DataFrame:
    """Rows (section, group, rank, key, title, score) of candidates (key, title, group, keywords, enabled, uses) for a query.

    Disabled candidates come only by their exact title, at the end. What scores less than a part of the best enabled row that
    is no prefix match is noise. Sections go by their best score, rows by score, then title in Unicode collation, then key.
    """
    trimmed = query.strip()
    empty = candidates.select(F.lit(0).alias("section"), "group", F.lit(0).alias("rank"), "key", "title", F.lit(0.0).alias("score")).limit(0)
    if not trimmed:
        return empty
    lower, exact = F.lower("title"), trimmed.lower()
    rows = candidates.where(F.col("enabled") | (lower == exact)).withColumn("s", score(F.col("title"), F.col("keywords"), trimmed))
    rows = rows.select("key", "title", "group", (F.startswith(lower, F.lit(exact)) | ~F.col("enabled")).alias("stays"), F.when(F.col("enabled"), F.col("s") + usage_boost(F.col("uses"))).otherwise(F.col("s") - 10_000).alias("score"))
    # The rows that stay and those that may be noise: of each the best of a group, and what ties with them, are all that can be shown.
    kinds = W.partitionBy("group", "stays")
    best = rows.withColumn("place", F.rank().over(kinds.orderBy(F.desc_nulls_last("score")))).where((F.col("place") <= per_group) & F.col("score").isNotNull())
    order = [F.desc("score"), F.collate("title", "UNICODE"), F.col("key")]
    best = best.withColumn("place", F.row_number().over(kinds.orderBy(*order))).where(F.col("place") <= per_group)
    top = F.max(F.when(~F.col("stays"), F.col("score"))).over(W.partitionBy())  # over few rows, as from here on
    kept = best.withColumn("floor", F.greatest(F.coalesce(top, F.lit(0.0)) * WEAK, F.lit(1.0))).where((F.col("stays") | (F.col("score") >= F.col("floor"))) & F.col("group").isNotNull())
    groups = W.partitionBy("group").orderBy(*order)
    shown = kept.select("group", F.row_number().over(groups).alias("rank"), "key", "title", "score", F.first(F.struct("score", "title", "key")).over(groups).alias("f")).where(F.col("rank") <= per_group)
    section = F.dense_rank().over(W.orderBy(F.desc("f.score"), F.collate("f.title", "UNICODE"), F.col("f.key"), F.col("group")))
    return shown.select(section.alias("section"), "group", "rank", "key", "title", "score")


def default_sections(candidates: DataFrame, recent: DataFrame, per_group: int = PER_GROUP) -> DataFrame:
    """Rows (section, group, rank, key, title) of enabled candidates (key, title, group, enabled, at) before anything is typed:
    the first recents (key, at) that can run, then all other groups in fixed order, unknown ones last by first row."""
    live = candidates.where("enabled").select("key", "title", "group", "at")
    used = recent.select("key", F.col("at").alias("used")).join(live, "key").orderBy("used").limit(RECENT)
    used = used.select(F.lit("Recent").alias("group"), "key", "title", F.row_number().over(W.orderBy("used")).alias("rank"))
    rest = live.join(F.broadcast(used.select("key")), "key", "left_anti").withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy("at"))).where(F.col("rank") <= per_group)
    known = F.create_map(*[F.lit(x) for i, g in enumerate(GROUPS) for x in (g, i)])
    place = F.coalesce(F.try_element_at(known, F.col("group")), F.lit(len(GROUPS)))
    first = rest.where("rank = 1").select("group", F.row_number().over(W.orderBy(place, "at")).alias("section"))
    shown = rest.join(F.broadcast(first), "group").select("section", "group", "rank", "key", "title")
    return used.select(F.lit(0).alias("section"), "group", "rank", "key", "title").unionByName(shown)


def with_page_jump(sections: DataFrame, query: str, page_count: int) -> DataFrame:
    """Puts a section with one row, a page to go to, before all others if the query is a bare page number of the document."""
    page = query.strip()
    if not (page.isascii() and page.isdigit() and len(page) <= 7 and 1 <= int(page) <= page_count):
        return sections
    row = [(-1, "Jump", 1, f"page:{int(page)}", f"Go to page {int(page)}")]
    jump = sections.sparkSession.createDataFrame(row, "section int, group string, rank int, key string, title string")
    return jump.unionByName(sections, allowMissingColumns=True)


class Uses(Fold):
    """Counts of the commands in use, the TRACKED largest after each use; equal counts stay in the order they had."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def step(self, row: dict) -> Iterator[tuple]:
        self.counts[row["id"]] = self.counts.get(row["id"], 0) + 1
        self.counts = dict(sorted(self.counts.items(), key=lambda x: -x[1])[:TRACKED])
        return iter(())

    def finish(self) -> Iterator[tuple]:
        return ((k, n, at) for at, (k, n) in enumerate(self.counts.items(), 1))


def most_used(log: DataFrame, owner: str, limit: int | None = None) -> DataFrame:
    """Rows (owner, id, uses, rank) from a log (owner, seq, id) of commands run."""
    rows = fold(log.select(owner, "seq", "id"), [owner], ["seq"], Uses, "id string, uses long, rank int")
    return rows if limit is None else rows.where(F.col("rank") <= limit)
