"""Scholarly identifiers in text: DOI and arXiv grammar as regular expressions, and what is built on them."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier grammar and the prefixes that make an identifier explicit.
DOI = r"10\.\d{4,9}/[A-Za-z0-9._;()/:,-]*[A-Za-z0-9_(/:-]"
ARXIV_MODERN = r"\d{4}\.\d{4,5}(?:[vV]\d+)?(?![A-Za-z0-9_])"
ARXIV_LEGACY = r"[A-Za-z0-9.-]{1,25}/\d{7}(?!\d)(?:[vV]\d+)?(?![A-Za-z0-9_])"
DOI_PREFIX = r"(?i:https://doi\.org/|http://doi\.org/|http://dx\.doi\.org/|doi:)"
ARXIV_PREFIX = r"(?i:https://arxiv\.org/abs/|http://arxiv\.org/abs/|arxiv\.org/abs/|https://arxiv\.org/pdf/|http://arxiv\.org/pdf/|arxiv\.org/pdf/|arxiv:)"
EXPLICIT = f"{DOI_PREFIX}({DOI})|{ARXIV_PREFIX}({ARXIV_MODERN}|{ARXIV_LEGACY})"
SCHEMA = "struct<scheme:string,value:string>"


def identifier(doi: Column, arxiv: Column) -> Column:
    """Struct (scheme, value) of the one that is not empty: DOIs lower-cased, arXiv ids without version; null if both are."""
    value = F.regexp_replace(arxiv, r"[vV]\d+\z", "")
    return (
        F.when(doi != "", F.struct(F.lit("doi").alias("scheme"), F.lower(doi).alias("value")))
        .when(arxiv != "", F.struct(F.lit("arxiv").alias("scheme"), value.alias("value")))
        .cast(SCHEMA)
    )


def explicit(text: Column) -> Column:
    """Array of identifiers with an explicit prefix, left to right."""
    doi = F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(1))
    arxiv = F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(2))
    return F.zip_with(doi, arxiv, identifier)


def spans(text: Column) -> Column:
    """Array of (scheme, value, start, len) of explicit identifiers: what precedes each is what splitting by them leaves."""
    hits = F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(0))
    gaps = F.split(text, EXPLICIT, -1)
    ids = explicit(text)

    def span(x, i):
        before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda n, g: n + F.char_length(g))
        own = F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda n, h: n + F.char_length(h))
        return F.struct(x["scheme"].alias("scheme"), x["value"].alias("value"), (before + own).alias("start"), F.char_length(F.get(hits, i)).alias("len"))

    return F.transform(ids, span)


def parse(text: Column) -> Column:
    """One identifier out of a string: an explicit one, or a bare DOI or arXiv id at its start."""
    core = F.btrim(text, F.lit(" \t\r\n<>\"'"))
    bare = identifier(F.regexp_extract(core, f"^({DOI})", 1), F.regexp_extract(core, f"^({ARXIV_MODERN}|{ARXIV_LEGACY})", 1))
    return F.coalesce(F.get(explicit(core), F.lit(0)), bare)


def from_filename(name: Column) -> Column:
    """An arXiv id that the name holds, else the first DOI whose slash is written as an underscore."""
    stem = F.regexp_replace(name, r"\.(?:pdf|PDF)\z", "")
    own = parse(F.regexp_replace(stem, r"^(?:arXiv|arxiv)[-_]", ""))
    doi = F.regexp_extract(F.regexp_replace(F.regexp_extract(stem, r"(10\.\d{4,9}_.*)$", 1), r"^(10\.\d{4,9})_", "$1/"), f"^({DOI})", 1)
    return F.when(own["scheme"] == "arxiv", own).otherwise(identifier(doi, F.lit("")))


def first_page(text: Column) -> Column:
    """Struct (doi, arxiv, title): the first of each explicit identifier, and the first line of more than 12 characters."""
    ids = explicit(text)
    pick = lambda scheme: F.get(F.filter(ids, lambda x: x["scheme"] == scheme), F.lit(0))["value"]
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\n\x0b\x0c\x85\xa0")))
    title = F.substring(F.get(F.filter(lines, lambda x: F.char_length(x) > 12), F.lit(0)), 1, 300)
    return F.struct(pick("doi").alias("doi"), pick("arxiv").alias("arxiv"), title.alias("title"))


def label(identifier: Column) -> Column:
    return F.concat(F.when(identifier["scheme"] == "doi", "doi:").otherwise("arXiv:"), identifier["value"])


def key(identifier: Column) -> Column:
    return F.concat_ws(":", identifier["scheme"], identifier["value"])




def scanned(name: Column, page: Column) -> Column:
    """The identifier that a scan finds: the file name's, else the first page's DOI or arXiv id, in this order."""
    own, ids = from_filename(name), first_page(page)
    read = F.when(ids["doi"].isNotNull(), F.struct(F.lit("doi").alias("scheme"), ids["doi"].alias("value"))).when(ids["arxiv"].isNotNull(), F.struct(F.lit("arxiv").alias("scheme"), ids["arxiv"].alias("value")))
    return F.coalesce(own, read)
