"""Headings, destinations and captions, as the printed page names them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Destinations that are never headings or environments.
STRUCTURAL = [
    "page.", "subsubsection.", "part.", "paragraph.", "subparagraph.", "cite.", "Item.", "thmt@dummyctr", "section*.",
    "chapter*.", "Hfootnote.", "footnote.", "equation.",
]
#: Grammar of headings and captions. Possessive, as a printed counter is never taken in part.
HEADING = r"^\s*(\p{Lu}\p{L}{2,}+)\s*+((?:[A-Z]{1,3}+|\d++)(?:\.\d++)*+)(?![A-Za-z0-9])"
CAPTION = r"(?i)^\s*(figure|fig\.|table|algorithm|alg\.|listing)\s*+((?:\d|\.(?=\d))++)\s*+(?:$|[:.)|–—][:.)|–— ]*+)(.*)$"
COUNTER = r"^[^.]*\.((?:[0-9]+|[A-Za-z]{1,3})(?:\.(?:[0-9]+|[A-Za-z]{1,3}))*)\z"


def is_structural(name: Column) -> Column:
    found = name.isin("Doc-Start", "Navigation")
    for prefix in STRUCTURAL:
        found = found | name.startswith(prefix)
    return found


def heading_depth(name: Column) -> Column:
    top = name.startswith("section.") | name.startswith("chapter.") | name.startswith("appendix.")
    return F.when(top, F.lit(0)).when(name.startswith("subsection."), F.lit(1))


def destination_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, COUNTER, 1), F.lit(""))


def heading(text: Column) -> Column:
    """Struct (kind, number) of a line that begins with a name and counter, else null."""
    kind, number = F.regexp_extract(text, HEADING, 1), F.regexp_extract(text, HEADING, 2)
    return F.when(kind != "", F.struct(kind.alias("kind"), number.alias("number")))


def caption(text: Column) -> Column:
    """Struct (label, title) of a line that begins a caption, else null."""
    word = F.regexp_extract(text, CAPTION, 1)
    label = F.concat(word, F.lit(" "), F.regexp_extract(text, CAPTION, 2))
    return F.when(word != "", F.struct(label.alias("label"), F.rtrim(F.regexp_extract(text, CAPTION, 3)).alias("title")))


def opens_with_counter(line: Column, counter: Column) -> Column:
    """Whether the line starts with the counter, then marks or spaces, then a letter."""
    rest = F.regexp_replace(line, r"^\s+", "")
    after = F.substring(rest, F.char_length(counter) + 1, F.char_length(rest))
    return F.coalesce(rest.startswith(counter) & after.rlike(r"^[.:) ]*\p{L}"), F.lit(False))


def truncate_words(text: Column, limit: int = 140) -> Column:
    """At most limit characters, cut at the last space of them, with a mark."""
    own = F.btrim(text)
    cut = F.substring(own, 1, limit)
    at = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.char_length(own) <= limit, own).otherwise(F.concat(F.rtrim(at), F.lit("…")))
