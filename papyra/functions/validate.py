"""Validators and parsers of what comes from outside: addresses, page ranges, printer tools."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("http", "https", "mailto")
MOST_URL_BYTES, MOST_TOKEN_BYTES, MOST_COPIES = 4096, 128, 99
#: Java's $ also matches before a last line end, so whole texts are matched by \\A and \\z.
TOKEN = r"\A[A-Za-z0-9._][A-Za-z0-9._-]{0,127}\z"


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) address, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)), F.lit(""))


def clean_url(raw: str | None) -> str | None:
    """The address in its normal form if it is http, https or mailto, of 4096 bytes at most, with a host and no control characters."""
    text = (raw or "").strip(" \t\n\r\f\x0b\x85\xa0")
    if not text or len(text.encode()) > MOST_URL_BYTES:
        return None
    text = text.replace("\t", "").replace("\n", "").replace("\r", "")
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in SCHEMES:
        return None
    safe = "!$&'()*+,;=:@/%-._~[]"
    tail = (f"?{quote(parts.query, safe=safe + '?{}|^`')}" if parts.query else "") + (f"#{quote(parts.fragment, safe=safe + '?{}|^#')}" if parts.fragment else "")
    if scheme == "mailto":
        return f"mailto:{quote(parts.path, safe=safe)}{tail}"
    if not parts.hostname:
        return None
    try:
        host = parts.hostname if ":" in parts.hostname else parts.hostname.encode("idna").decode()
    except UnicodeError:
        return None
    if not host or any(c in " <>\\^|%" for c in host):
        return None
    host = f"[{host}]" if ":" in host else host
    user = parts.netloc.rpartition("@")[0]
    shown = (f"{quote(user, safe=':%')}@" if user else "") + host + (f":{port}" if port and port != {"http": 80, "https": 443}[scheme] else "")
    out = f"{scheme}://{shown}{quote(parts.path, safe=safe) or '/'}{tail}"
    return None if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in out) else out


def _clean_urls(urls: pd.Series) -> pd.Series:
    return urls.map(clean_url)


def sanitized_url(url: Column) -> Column:
    return F.pandas_udf(_clean_urls, "string")(url)


def is_page_range(text: Column) -> Column:
    """`3`, `2-5`, `1,4,7-9`: pages of 1 to 6 digits above 0, no range backwards, 128 bytes at most."""
    number = lambda p, i: F.split_part(p, F.lit("-"), F.lit(i)).try_cast("int")
    shape = text.rlike(r"\A\d{1,6}(-\d{1,6})?(,\d{1,6}(-\d{1,6})?)*\z") & (F.octet_length(text) <= MOST_TOKEN_BYTES)
    good = F.forall(F.split(text, ","), lambda p: (number(p, 1) > 0) & (~p.contains("-") | (number(p, 2) >= number(p, 1))))
    return F.coalesce(shape & good, F.lit(False))


def range_problem(text: Column, pages: Column) -> Column:
    """What is wrong with a range, as shown to its writer, or null: the first bad part decides. The messages are fixed values."""
    own = F.btrim(text, F.lit(" \t\r\n"))

    def wrong(p):
        one, two = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("long"), F.split_part(p, F.lit("-"), F.lit(-1)).try_cast("long")
        return (
            F.when(~p.rlike(r"\A\d+(-\d+)?\z"), F.concat(F.lit('"'), p, F.lit('" is not a page or a range.')))
            .when((one < 1) | (two < 1), F.lit("Pages start at 1."))
            .when(two < one, F.concat(F.lit('"'), p, F.lit('" runs backwards.')))
            .when(two > pages, F.concat(F.lit("This document has "), pages.cast("string"), F.lit(" pages.")))
        )

    first = F.get(F.filter(F.transform(F.split(own, ",", -1), wrong), lambda w: w.isNotNull()), F.lit(0))
    return F.when(own == "", "Enter a range like 1-4, or choose All.").when(own.rlike(r"\s"), "Ranges cannot contain spaces.").otherwise(first)


def pages_in_range(text: Column, pages: Column) -> Column:
    """Sorted 0-based pages of a range, or null if any part is malformed or beyond the document."""
    part = lambda p, i: F.split_part(p, F.lit("-"), F.lit(i)).try_cast("int")
    shape = text.rlike(r"\A\d+(-\d+)?(,\d+(-\d+)?)*\z")
    good = F.forall(F.split(text, ","), lambda p: (part(p, 1) >= 1) & (part(p, -1) >= part(p, 1)) & (part(p, -1) <= pages))
    every = F.flatten(F.transform(F.split(text, ","), lambda p: F.sequence(part(p, 1) - 1, part(p, -1) - 1)))
    return F.when(F.coalesce(shape & good, F.lit(False)), F.array_sort(F.array_distinct(every)))


def is_safe_token(text: Column) -> Column:
    return F.coalesce(text.rlike(TOKEN), F.lit(False))


def printers(listing: Column, default: Column) -> Column:
    """Array of (name, is_default) from a printer listing and the line that names the default."""
    chosen = F.regexp_extract(default, r"(?m)^.*: (.*)$", 1)
    names = F.regexp_extract_all(listing, F.lit(r"(?m)^printer (\S+)"), F.lit(1))
    return F.transform(F.filter(names, is_safe_token), lambda n: F.struct(n.alias("name"), (n == F.btrim(chosen)).alias("is_default")))


def printer_options(text: Column) -> Column:
    """Array of (key, label, choices, default) from lines `Key/Label: a *b c`; those with one choice offer nothing."""

    def option(line):
        name = F.split_part(line, F.lit(":"), F.lit(1))
        key = F.btrim(F.split_part(name, F.lit("/"), F.lit(1)))
        label = F.when(name.contains("/"), F.regexp_replace(name, "^[^/]*/", "")).otherwise(name)
        raw = F.filter(F.split(F.btrim(F.regexp_replace(line, "^[^:]*:", "")), r"\s+"), lambda v: is_safe_token(F.regexp_replace(v, r"^\*", "")))
        choices = F.transform(raw, lambda v: F.regexp_replace(v, r"^\*", ""))
        starred = F.filter(raw, lambda v: v.startswith("*"))
        default = F.coalesce(F.regexp_replace(F.try_element_at(starred, F.lit(-1)), r"^\*", ""), F.try_element_at(choices, F.lit(1)))
        return F.struct(key.alias("key"), F.btrim(label).alias("label"), choices.alias("choices"), default.alias("default"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    return F.filter(F.transform(lines, option), lambda o: is_safe_token(o["key"]) & (F.size(o["choices"]) >= 2))


def print_arguments(printer: Column, copies: Column, pages: Column, options: Column, path: Column) -> Column:
    """Argument list of a print job, or null if any part isn't plain. options: array of (key, value); pages may be null."""
    plain = is_safe_token(printer) & copies.between(1, MOST_COPIES) & (pages.isNull() | is_page_range(pages))
    plain = plain & F.forall(options, lambda o: is_safe_token(o["key"]) & is_safe_token(o["value"]))
    ranges = F.when(pages.isNotNull(), F.array(F.lit("-o"), F.concat(F.lit("page-ranges="), pages))).otherwise(F.array().cast("array<string>"))
    extra = F.flatten(F.transform(options, lambda o: F.array(F.lit("-o"), F.concat(o["key"], F.lit("="), o["value"]))))
    return F.when(plain, F.concat(F.array(F.lit("-d"), printer, F.lit("-n"), copies.cast("string")), ranges, extra, F.array(path)))


def page_jump(text: Column, pages: Column) -> Column:
    own = F.btrim(text)
    n = F.when(own.rlike(r"\A\d{1,7}\z"), own.cast("int"))
    return F.when(n.between(1, pages), n)


def is_print_file(path: Column, folder: Column, prefix: str = "papyra-print-") -> Column:
    """Whether a path names the file of a print job, right below the folder where they are made."""
    return F.coalesce(path.rlike(r"\A.*/" + prefix + r"[^/]*\.pdf\z") & (F.regexp_replace(path, r"/[^/]*\z", "") == F.rtrim(folder, F.lit("/"))), F.lit(False))
