"""Small codecs and formats: sizes, colours, shortcuts, labels, render addresses, script markup."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of mathematical fonts, ligatures, and parts of shortcuts.
MATH_FONTS = ["CMMI", "CMSY", "CMEX", "MSAM", "MSBM", "MathItalic", "MathSymbol", "Math-Italic"]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PC_PARTS = {"mod": "Ctrl", "ctrl": "Ctrl", "shift": "Shift", "alt": "Alt", "plus": "+", "minus": "−", "backspace": "Backspace", "pagedown": "PgDn", "pageup": "PgUp", "tab": "Tab"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def byte_size(n: Column) -> Column:
    """Bytes below 1024, else KB, MB or GB, with one decimal below 10. Ties go up, as in the reference's toFixed."""
    value = F.when(n < 1024**2, n / 1024.0).when(n < 1024**3, n / 1024.0**2).otherwise(n / 1024.0**3).cast("double")
    unit = F.when(n < 1024**2, "KB").when(n < 1024**3, "MB").otherwise("GB")
    tenths = F.floor(value * 10 + 0.5)
    one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    shown = F.when(value < 10, one).otherwise(F.floor(value + 0.5).cast("string"))
    return F.when(n.isNull(), "–").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), unit))


def shown_date(ms: Column, today: Column) -> Column:
    """Time of day if the moment is today, else the date."""
    at = F.timestamp_millis(ms)
    return F.when(F.to_date(at) == today, F.date_format(at, "h:mm a")).otherwise(F.date_format(at, "MMM d, yyyy"))


def expand_ligatures(text: Column) -> Column:
    for mark, letters in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(letters))
    return text


def is_math_font(name: Column) -> Column:
    """Whether the family, without a subset tag up to `+`, names mathematics."""
    family = F.regexp_replace(name, r"^[^+]*\+", "")
    return F.coalesce(family.rlike("(?i)" + "|".join(MATH_FONTS)), F.lit(False))


def link_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def humanized(choice: Column) -> Column:
    return F.regexp_replace(choice, "([a-z])([A-Z])", "$1 $2")


def option_label(known: dict[str, str], key: Column, reported: Column) -> Column:
    return F.coalesce(lookup(known, key), F.when((reported != "") & (reported != key), reported), key)


def shortcut(spec: Column, parts: dict[str, str] = PC_PARTS, joint: str = "+") -> Column:
    return F.array_join(F.transform(F.split(spec, r"\+"), lambda p: F.coalesce(lookup(parts, p), F.upper(p))), joint)


def colour_channels(text: Column) -> Column:
    """Struct (r, g, b) of #rrggbb; shorter or malformed ones are black."""
    digits = F.regexp_replace(text, "^#+", "")
    ok = digits.rlike("^[0-9A-Fa-f]{6}\\z")
    channel = lambda at: F.when(ok, F.conv(F.substring(digits, at, 2), 16, 10).cast("int")).otherwise(0)
    return F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"))


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x), 2, "0")) for x in (r, g, b)])


def opacity(alpha: Column) -> Column:
    """Share of 255; a transparent colour counts as opaque, as writers leave alpha at 0."""
    return F.when(alpha == 0, 1.0).otherwise(alpha / 255.0)


def render_address(doc: Column, src: Column, rot: Column, scale: Column, gen: Column, kind: Column) -> Column:
    pair = lambda k, v: F.concat(F.lit(f"{k}="), v.cast("string"))
    return F.concat(F.lit("pdfr://localhost/render?"), F.concat_ws("&", pair("doc", doc), pair("src", src), pair("rot", rot), pair("scale", scale), pair("gen", gen), pair("kind", kind)))


def render_fields(address: Column) -> Column:
    """Struct of the fields of a render address, null if rotation or scale is out of range."""
    fields = F.str_to_map(F.substring_index(address, "?", -1), F.lit("&"), F.lit("="))
    number = lambda k, d: F.coalesce(F.try_element_at(fields, F.lit(k)).try_cast("long"), F.lit(d))
    rot, scale = number("rot", 0), number("scale", 1000)
    ok = (rot % 90 == 0) & (rot < 360) & scale.between(1, 12_000) & F.try_element_at(fields, F.lit("doc")).isNotNull()
    kind = F.coalesce(F.try_element_at(fields, F.lit("kind")), F.lit("page"))
    kind = F.when(kind.isin("thumb", "tile", "preview"), kind).otherwise("page")
    return F.when(ok, F.struct(number("doc", 0).alias("doc"), number("src", 0).alias("src"), rot.alias("rot"), scale.alias("scale"), number("gen", 0).alias("gen"), kind.alias("kind")))


def utf16_text(data: Column) -> Column:
    """Text of little-endian UTF-16 up to the first NUL."""
    return F.split_part(F.decode(data, "UTF-16LE"), F.lit("\x00"), F.lit(1))


def script_segments(value: str) -> list[tuple[str, str]]:
    """(text, kind) segments of `x^2`, `a_{ij}`: a mark lifts the next character or the braces after it."""
    kinds, out, at = {"^": "super", "_": "sub"}, [], 0

    def plain(c: str) -> None:
        if out and out[-1][1] == "normal":
            out[-1] = (out[-1][0] + c, "normal")
        else:
            out.append((c, "normal"))

    while at < len(value):
        kind, rest = kinds.get(value[at]), value[at + 1 :]
        if kind and rest.startswith("{") and "}" in rest:
            inner = rest[1 : rest.index("}")]
            if inner:
                out.append((inner, kind))
            at += len(inner) + 3
        elif kind and rest and not rest.startswith("{"):
            out.append((rest[0], kind))
            at += 2
        else:
            plain(value[at])
            at += 1
    return out


def _segments(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"text": t, "kind": k} for t, k in script_segments(v or "")])


def script_markup(value: Column) -> Column:
    return F.pandas_udf(_segments, "array<struct<text:string,kind:string>>")(value)


def plain_script(value: Column) -> Column:
    """Text without marks: JVM-side, equal to joining the segments."""
    return F.regexp_replace(value, r"[\^_](?:\{([^}]*)\}|([^{]))", "$1$2")


def snippet_parts(snippet: Column, query: str) -> Column:
    """Array of (text, match): the query's words, any white space between them, without case, everywhere."""
    words = query.split()
    if not words:
        return F.array(F.struct(snippet.alias("text"), F.lit(False).alias("match")))
    quoted = ["\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words]
    pattern = "(?iu)" + "\\s+".join(quoted)
    gaps, hits = F.split(snippet, pattern, -1), F.regexp_extract_all(snippet, F.lit(pattern), F.lit(0))
    part = lambda text, match: F.struct(text.alias("text"), F.lit(match).alias("match"))
    both = F.zip_with(gaps, hits, lambda g, h: F.array(part(g, False), part(h, True)))
    out = F.filter(F.flatten(both), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.when(F.size(out) == 0, F.array(part(snippet, False))).otherwise(out)


def markdown_notes(notes: DataFrame, doc: str, title: Column) -> DataFrame:
    """Rows (doc, markdown): notes (doc, page, at, quote, note) by page, quotations line by line behind `>`; blank ones are left
    out. A document is one text; those without any notes have no row."""
    quote = F.when(F.col("quote") != "", F.regexp_replace("quote", "(?m)^", "> "))
    body = F.concat_ws("\n\n", quote, F.when(F.col("note") != "", F.col("note")))
    rows = notes.select(F.col(doc), title.alias("title"), "page", "at", body.alias("body")).where("body <> ''")
    held = rows.groupBy(doc, "title").agg(F.sort_array(F.collect_list(F.struct("page", "at", "body"))).alias("n"))
    entry = F.transform("n", lambda n: F.concat(F.lit("**Page "), n["page"] + 1, F.lit("**\n\n"), n["body"]))
    return held.select(doc, F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(entry, "\n\n"), F.lit("\n")).alias("markdown"))


def _latex(node: dict) -> str:
    if "text" in node:
        return node["text"]
    parts = [_latex(c) for c in node.get("children", [])]
    tag, n = node["tag"], len(parts)
    braced = [p if len(p) == 1 else "{" + p + "}" for p in parts]
    if tag == "mphantom":
        return ""
    if n == 2 and tag in ("msup", "mover"):
        return f"{parts[0]}^{braced[1]}"
    if n == 2 and tag in ("msub", "munder"):
        return f"{parts[0]}_{braced[1]}"
    if n == 3 and tag in ("msubsup", "munderover"):
        return f"{parts[0]}_{braced[1]}^{braced[2]}"
    if n == 2 and tag == "mfrac":
        return rf"\frac{{{parts[0]}}}{{{parts[1]}}}"
    if n == 2 and tag == "mroot":
        return rf"\sqrt[{parts[1]}]{{{parts[0]}}}"
    text = "".join(parts)
    return rf"\sqrt{{{text}}}" if tag == "msqrt" else text


def latex(tree: Column) -> Column:
    """LaTeX of a JSON tree of marked-up mathematics: nodes with a tag and children, leaves with a text. Null: null."""

    @F.pandas_udf("string")
    def run(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: None if t is None else _latex(json.loads(t)))

    return run(tree)


def span_start(text: Column, start: Column, claimed: Column, back: int = 6) -> Column:
    """Where a span really begins: it takes in up to `back` characters before it that no other span has claimed, but does not
    begin with white space."""
    before = F.reverse(F.filter(F.sequence(F.greatest(start - back, F.lit(0)), start), lambda i: i < start))
    state = F.struct(start.alias("start"), F.lit(True).alias("on"))

    def step(s, i):
        on = s["on"] & ~F.array_contains(claimed, i)
        ink = ~F.substring(text, i + 1, F.lit(1)).rlike(r"\A\s\z")
        return F.struct(F.when(on & ink, i).otherwise(s["start"]).alias("start"), on.alias("on"))

    return F.aggregate(before, state, step, lambda s: s["start"])
