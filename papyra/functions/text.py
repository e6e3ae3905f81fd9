"""Text normalisation and matching: the exact kernels, and JVM-side forms for texts on which they agree.

Search text is made in one pass over code points: a run of white space becomes one space (none at the start), eight
quotation marks are straightened, and every other character is NFKC-normalised by itself. Folding takes the first
character of each character's lower case, so lengths stay. An offset map holds the index in normalised text at which
raw index - normalised index changes, and the new difference.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that count as white space, as ranges.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Quotation marks and what they become.
QUOTES = {**dict.fromkeys("\u2018\u2019\u201a\u2032", "'"), **dict.fromkeys("\u201c\u201d\u201e\u2033", '"')}
_white = re.compile(f"[{WHITE}]")
#: Texts of these characters alone need no Unicode tables: ASCII but for control characters, and the Latin-1 letters.
SIMPLE = r"\A[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]*\z"
SNIPPET = 30
BREAKS = "array<struct<at:int,delta:int>>"


class _Mapped(dict):
    """What a character becomes; kept for those met."""

    def __missing__(self, c: str) -> str:
        self[c] = QUOTES.get(c) or unicodedata.normalize("NFKC", c)
        return self[c]


_mapped = _Mapped()
_run = re.compile(f"([^{WHITE}]+)([{WHITE}]*)")


def normalize(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """Normalised text and its offset map, run by run of characters between white space."""
    out: list[str] = []
    breaks: list[tuple[int, int]] = []
    at = 0

    def mark(index: int, delta: int) -> None:
        if not breaks or breaks[-1][1] != delta:
            breaks.append((index, delta))

    for run in _run.finditer(raw):
        new = [_mapped[c] for c in run[1]]
        text = "".join(new)
        if len(text) == len(new):
            mark(at, run.start() - at)
        else:  # characters of several lie further left with each
            place = at
            for i, chars in enumerate(new, run.start()):
                for _ in chars:
                    mark(place, i - place)
                    place += 1
        out.append(text)
        at += len(text)
        if run[2]:
            mark(at, run.end(1) - at)
            out.append(" ")
            at += 1
    return "".join(out), breaks


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower()[0] for c in text)


def prepare_query(query: str, case_sensitive: bool = False) -> str:
    """The query as it is looked for; white space at its end stays as one space."""
    text = normalize(query)[0]
    return text if case_sensitive else fold(text)


def raw_index(breaks: list[tuple[int, int]], index: int) -> int:
    """Where a normalised index lies in the raw text."""
    found = bisect_right(breaks, index, key=lambda b: b[0])
    return max(0, index + (breaks[found - 1][1] if found else 0))


def matches(raw: str, prepared: str, case_sensitive: bool = False, limit: int = 200) -> list[tuple[int, int, str]]:
    """Non-overlapping occurrences, left to right: (raw start, raw length, snippet)."""
    if not prepared:
        return []
    text, breaks = normalize(raw)
    hay = text if case_sensitive else fold(text)
    found, at = [], hay.find(prepared)
    while at >= 0 and len(found) < limit:
        start, last = raw_index(breaks, at), raw_index(breaks, at + len(prepared) - 1)
        found.append((start, last - start + 1, text[max(0, at - SNIPPET) : at + len(prepared) + SNIPPET]))
        at = hay.find(prepared, at + len(prepared))
    return found


def _normalized(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        if r is None:
            rows.append(("", "", []))
            continue
        text, breaks = normalize(r)
        rows.append((text, fold(text), [{"at": a, "delta": d} for a, d in breaks]))
    return pd.DataFrame(rows, columns=["normalized", "folded", "breaks"])


def normalized_exact(raw: Column) -> Column:
    """Struct of normalized, folded and breaks, by the kernel."""
    return F.pandas_udf(_normalized, f"normalized string, folded string, breaks {BREAKS}")(raw)


def normalized_simple(raw: Column) -> Column:
    """JVM-side form, equal to the kernel on texts that match SIMPLE."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[\x09-\x0D\x20]+", ""), r"[\x09-\x0D\x20]+", " ")


def folded_simple(normalized: Column) -> Column:
    return F.lower(normalized)


def breaks_simple(raw: Column, size: Column) -> Column:
    """Offset map of texts that match SIMPLE, of which size is the normalised length.

    There is one break at the start and one after each run of several white characters, which becomes one space. Texts are
    split at those runs alone, so that most have one piece.
    """
    lead = F.char_length(F.regexp_extract(raw, r"\A[\x09-\x0D\x20]*", 0))
    rest = F.substring(raw, lead + 1, F.char_length(raw))
    pieces = F.split(rest, r"[\x09-\x0D\x20]{2,}")
    runs = F.regexp_extract_all(rest, F.lit(r"[\x09-\x0D\x20]{2,}"), F.lit(0))
    both = F.transform(runs, lambda run, i: F.struct(F.char_length(F.get(pieces, i)).alias("text"), F.char_length(run).alias("run")))
    start = F.struct(F.lit(0).alias("at"), lead.alias("delta"), F.array(F.struct(F.lit(0).alias("at"), lead.alias("delta"))).cast(BREAKS).alias("out"))

    def step(state, piece):
        at, delta = state["at"] + piece["text"] + 1, state["delta"] + piece["run"] - 1
        return F.struct(at.alias("at"), delta.alias("delta"), F.concat(state["out"], F.array(F.struct(at.alias("at"), delta.alias("delta")))).alias("out"))

    every = F.when(F.size(runs) == 0, start["out"]).otherwise(F.aggregate(both, start, step, lambda s: s["out"]))
    return F.filter(every, lambda b: b["at"] < size)


def offset_lookup(breaks: Column, index: Column) -> Column:
    """As-of lookup in an offset map: the last break at or before the index."""
    before = F.filter(breaks, lambda b: b["at"] <= index)
    return F.greatest(F.lit(0), index + F.coalesce(F.try_element_at(before, F.lit(-1))["delta"], F.lit(0)))


def may_hold(raw: Column, prepared: str) -> Column:
    """Whether a raw page may hold a prepared query. Normalisation keeps the words of SIMPLE pages, so all words of the query
    must be in their lower case; other pages always may."""
    text = F.coalesce(raw, F.lit(""))
    every = F.lit(True)
    for word in dict.fromkeys(prepared.lower().split(" ")):
        if word:
            every = every & F.contains(F.lower(text), F.lit(word))
    return every | ~text.rlike(SIMPLE)


def with_search_text(pages: DataFrame, raw: str = "raw", breaks: bool = False) -> DataFrame:
    """Adds normalized, folded (and breaks) in one pass: JVM-side where texts are simple, by the exact kernel for the rest, which
    alone is sent to Python."""
    text = F.coalesce(F.col(raw), F.lit(""))
    rows = pages.withColumn("__simple", text.rlike(SIMPLE))
    rows = rows.withColumn("__n", normalized_exact(F.when(~F.col("__simple"), F.col(raw))))
    rows = rows.withColumn("normalized", F.when(F.col("__simple"), normalized_simple(text)).otherwise(F.col("__n.normalized")))
    rows = rows.withColumn("folded", F.when(F.col("__simple"), folded_simple(F.col("normalized"))).otherwise(F.col("__n.folded")))
    if breaks:
        rows = rows.withColumn("breaks", F.when(F.col("__simple"), breaks_simple(text, F.char_length("normalized"))).otherwise(F.col("__n.breaks")))
    return rows.drop("__n", "__simple")


def page_cost(normalized: Column, folded: Column, breaks: Column) -> Column:
    """Bytes that a page counts in a budget."""
    return F.lit(64) + F.octet_length(normalized) + F.octet_length(folded) + 8 * F.size(breaks)


def occurrences(text: Column, prepared: str) -> Column:
    """How often prepared occurs in text without overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(prepared), F.lit("")))) / len(prepared)).cast("int")


MATCHES = "array<struct<start:int,len:int,snippet:string>>"


def match_list(raw: Column, query: str, case_sensitive: bool, limit: int) -> Column:
    """Array of a raw page's matches: raw start, raw length and snippet, left to right, by the kernel. For pages that do match."""
    prepared = prepare_query(query, case_sensitive)

    @F.pandas_udf(MATCHES)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda r: [{"start": a, "len": n, "snippet": t} for a, n, t in matches(r or "", prepared, case_sensitive, limit)])

    return run(raw)
