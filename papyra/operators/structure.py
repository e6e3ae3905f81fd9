"""Structure of pages out of characters and runs: text runs, visual lines, prose, captions, headings, figures and links.

What depends on what came before it on a page is a fold over the page's rows in order; all else is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions.geometry import clamp
from papyra.operators.folds import Fold, fold

#: When a character begins a new run (by the run's height), when a baseline is another line (points).
RUN_DRIFT, RUN_GAP, RUN_BACK, LINE_BAND = 0.6, 0.6, 2.0, 8.0
#: Copied lines by the median height: a space, the same line, another line, a paragraph's gap and indent.
WORD_GAP, SAME_LINE, OTHER_LINE, PARAGRAPH, INDENT = 0.25, 0.6, 1.6, 0.9, 0.6
#: Captions: gap and indent by line height, longest title; anchors: tolerances in points and characters of text.
CAPTION_GAP, CAPTION_INDENT, CAPTION_TITLE = 2.2, 2.0, 140
ANCHOR_ABOVE, ANCHOR_LINE, ANCHOR_LEFT, ANCHOR_TEXT, HEADING_LEFT = 6.0, 5.0, 4.0, 400, 12.0
#: Scripts by size and offset; links that are too many for one address.
SCRIPT_SIZE, SCRIPT_BOX, SCRIPT_OFFSET, RUNAWAY_RECTS, RUNAWAY_SPAN = 0.85, 0.8, 0.15, 12, 0.45
HYPHENS = "-‐‑­"


class Runs(Fold):
    """Characters (at, ch, x, y, w, h) to runs. A run's box and height grow with it, and the next character is held against them."""

    def __init__(self):
        self.run: dict | None = None

    def closed(self) -> Iterator[tuple]:
        r, self.run = self.run, None
        if r and r["text"].strip() and r["right"] > r["x"] and r["top"] > r["y"]:
            yield r["start"], r["text"], r["x"], r["y"], r["right"] - r["x"], r["top"] - r["y"]

    def step(self, c: dict) -> Iterator[tuple]:
        if c["ch"] in ("\n", "\r"):
            return self.closed()
        if not (c["w"] or c["h"]):
            return iter(())  # no box: in the text, in no run
        r, out, middle = self.run, iter(()), c["y"] + c["h"] / 2
        if r:
            gap = c["x"] - r["last"]
            if abs(middle - (r["y"] + r["top"]) / 2) > RUN_DRIFT * r["tall"] or gap > RUN_GAP * r["tall"] or gap < -RUN_BACK * r["tall"]:
                out, r = iter(list(self.closed())), None
        if not r:
            r = self.run = {"start": c["at"], "text": "", "x": c["x"], "y": c["y"], "right": c["x"], "top": c["y"], "tall": 1.0}
        right, top = c["x"] + c["w"], c["y"] + c["h"]
        r.update(text=r["text"] + c["ch"], x=min(r["x"], c["x"]), y=min(r["y"], c["y"]), right=max(r["right"], right), top=max(r["top"], top), last=right, tall=max(r["tall"], c["h"]))
        return out

    def finish(self) -> Iterator[tuple]:
        return self.closed()


def text_runs(chars: DataFrame, page: list[str]) -> DataFrame:
    """Runs (page, start, text, x, y, w, h) of characters (page, at, ch, x, y, w, h) in order of `at`."""
    return fold(chars.select(*page, "at", "ch", *"xywh"), page, ["at"], Runs, "start long, text string, x double, y double, w double, h double")


class Lines(Fold):
    """Characters to visual lines. The first box of a line is its baseline; line ends in the text say nothing. Scripts are
    written out: smaller characters above or below the baseline, in braces if they are several."""

    def __init__(self):
        self.chars: list[dict] = []
        self.base: float | None = None
        self.boundary = False

    def closed(self) -> Iterator[tuple]:
        chars, base, self.chars, self.base = self.chars, self.base, [], None
        if not chars:
            return
        boxed = [c for c in chars if c["w"] > 0 and c["h"] > 0]
        text = with_scripts(chars, base or 0.0)
        if text:
            tall = max([c["h"] for c in boxed if abs(c["y"] - (base or 0.0)) < 1.0], default=1.0)
            yield chars[0]["at"], text, min((c["x"] for c in boxed), default=None), base or 0.0, max(tall, 1.0)

    def step(self, c: dict) -> Iterator[tuple]:
        if c["ch"] in ("\n", "\r"):
            self.boundary = True
            return iter(())
        out: list[tuple] = []
        if c["w"] > 0 and c["h"] > 0:
            if self.base is not None and abs(c["y"] - self.base) > LINE_BAND:
                out = list(self.closed())
            if self.base is None:
                self.base = c["y"]
        self.chars.append({**c, "after": self.boundary})
        self.boundary = False
        return iter(out)

    def finish(self) -> Iterator[tuple]:
        return self.closed()


def body_size(sizes: list[float]) -> float:
    """The commonest size, within a hair; of equals the smaller. 0 without sizes."""
    best, run = (0, 0.0), (0, 0.0)
    for s in sorted(s for s in sizes if s > 0):
        run = (run[0] + 1, run[1]) if run[0] and abs(s - run[1]) < 0.05 else (1, s)
        best = max(best, run, key=lambda r: r[0])
    return best[1]


def script_of(c: dict, base: float, body: float, tall: float) -> str:
    """`^`, `_` or nothing: how a character stands on its line."""
    smaller = c["size"] <= SCRIPT_SIZE * body if c["size"] > 0 and body > 0 else 0 < c["h"] <= SCRIPT_BOX * tall
    if not smaller or c["w"] <= 0 or c["h"] <= 0 or not (c["ch"].isalnum() or (c["math"] and not c["ch"].isspace())):
        return ""
    off = c["y"] - base
    return "^" if off >= SCRIPT_OFFSET * tall else "_" if off <= -SCRIPT_OFFSET * tall else ""


def braced(run: str, mark: str) -> str:
    return run if not mark or not run else mark + (run if len(run) == 1 else "{" + run + "}")


def with_scripts(chars: list[dict], base: float) -> str:
    tall = max([c["h"] for c in chars if c["h"] > 0 and abs(c["y"] - base) < 1.0], default=1.0)
    tall, body = max(tall, 1.0), body_size([c["size"] for c in chars if not c["ch"].isspace()])
    out, run, mark, right = "", "", "", None
    for c in chars:
        kind = script_of(c, base, body, tall)
        if c["after"] and c["w"] > 0 and not c["ch"].isspace() and right is not None and c["x"] - right > 0.35 * tall and not (run or out).endswith(" "):
            out, run, mark = out + braced(run, mark) + " ", "", ""
        if c["w"] > 0:
            right = c["x"] + c["w"]
        if kind != mark:
            out, run, mark = out + braced(run, mark), "", kind
        run += c["ch"]
    out += braced(run, mark)
    control = [i for i, x in enumerate(out) if ord(x) < 32 or 127 <= ord(x) < 160]
    if control and not out[control[-1] + 1 :].strip():
        out = out[: control[-1]] + "-" + out[control[-1] + 1 :]
    return "".join(x for x in out if not (ord(x) < 32 or 127 <= ord(x) < 160)).strip()


def visual_lines(chars: DataFrame, page: list[str]) -> DataFrame:
    """Lines (page, start, text, x, y, height) of characters (page, at, ch, x, y, w, h, size, math)."""
    return fold(chars.select(*page, "at", "ch", *"xywh", "size", "math"), page, ["at"], Lines, "start long, text string, x double, y double, height double")


class Prose(Fold):
    """Runs (page, at, x, y, w, h, text, median) of a selection to prose: lines joined by a space, a paragraph or, where a
    hyphen breaks a word, nothing."""

    def __init__(self):
        self.out, self.line, self.before, self.median = "", None, None, 11.0

    def join(self) -> None:
        """Adds the line that ends to what there is."""
        a, b = self.before, self.line
        if b is None:
            return
        if a is None:
            self.out = b["text"]
        elif a["text"].rstrip()[-1:] in tuple(HYPHENS) and b["text"].lstrip()[:1].isascii() and b["text"].lstrip()[:1].islower():
            self.out = self.out.rstrip()[:-1] + b["text"].lstrip()
        else:
            on = b["page"] == a["page"] and b["top"] <= a["top"]
            new = on and (a["bottom"] - b["top"] > PARAGRAPH * self.median or b["x"] - a["x"] > INDENT * self.median)
            self.out += ("\n\n" if new else " ") + b["text"]
        self.before, self.line = b, None

    def step(self, r: dict) -> Iterator[tuple]:
        self.median, text, now = r["median"], r["text"], self.line
        if not text:
            return iter(())
        drop = abs(now["y"] - r["y"]) if now else 0.0
        if not now or r["page"] != now["page"] or drop > OTHER_LINE * self.median or (drop > SAME_LINE * self.median and r["x"] < now["right"] - 0.1 * self.median):
            self.join()
            self.line = {"page": r["page"], "y": r["y"], "top": r["y"] + r["h"], "bottom": r["y"], "x": r["x"], "right": r["x"] + r["w"], "text": text}
            return iter(())
        space = r["x"] - now["right"] > WORD_GAP * self.median and not now["text"][-1:].isspace() and not text[:1].isspace()
        now.update(text=now["text"] + " " * space + text, top=max(now["top"], r["y"] + r["h"]), bottom=min(now["bottom"], r["y"]), x=min(now["x"], r["x"]), right=max(now["right"], r["x"] + r["w"]))
        return iter(())

    def finish(self) -> Iterator[tuple]:
        self.join()
        lines = [" ".join(x for x in line.replace("\t", " ").split(" ") if x) for line in self.out.replace("­", "").split("\n")]
        yield ("\n".join(lines).strip(),)


def copied_prose(runs: DataFrame, key: str) -> DataFrame:
    """Text (key, text) that copying runs (key, page, start, text, x, y, w, h) gives; ligatures are to be expanded before."""
    median = runs.groupBy(key).agg(F.coalesce(F.percentile(F.greatest("h", F.lit(1.0)), 0.5), F.lit(11.0)).alias("median"))
    return fold(runs.join(median, key), [key], ["page", "start"], Prose, "text string")


class Captions(Fold):
    """Lines (start, text, x, y, height, label, rest) to captions: those with a label, and what follows closely below."""

    def __init__(self):
        self.open: dict | None = None

    def closed(self) -> Iterator[tuple]:
        c, self.open = self.open, None
        if c:
            title = c["title"].strip()
            cut = title[:CAPTION_TITLE]
            yield c["start"], c["label"], title if len(title) <= CAPTION_TITLE else cut[: cut.rfind(" ") if " " in cut else len(cut)].rstrip() + "…", c["x"], c["y"]

    def step(self, line: dict) -> Iterator[tuple]:
        c = self.open
        if line["label"] is not None:
            out = list(self.closed())
            self.open = {"start": line["start"], "label": line["label"], "title": line["rest"] or "", "x": line["x"], "y": line["y"], "last": line}
            return iter(out)
        if not c:
            return iter(())
        last, tall = c["last"], max(c["last"]["height"], 1.0)
        joins = len(c["title"]) < CAPTION_TITLE and line["y"] < last["y"] and last["y"] - line["y"] <= CAPTION_GAP * tall and abs(line["x"] - c["x"]) <= CAPTION_INDENT * tall
        if not joins:
            return self.closed()
        if c["title"].rstrip()[-1:] in ("-", "‐") and line["text"].lstrip()[:1].islower():
            c["title"] = c["title"].rstrip()[:-1] + line["text"].lstrip()
        else:
            c["title"] += (" " if c["title"] and not c["title"].endswith(" ") else "") + line["text"]
        c["last"] = line
        return iter(())

    def finish(self) -> Iterator[tuple]:
        return self.closed()


def captions(lines: DataFrame, page: list[str]) -> DataFrame:
    """Captions (page, start, label, title, x, y) of lines (page, start, text, x, y, height, label, rest), label null where none begins."""
    return fold(lines.select(*page, "start", "text", "x", "y", "height", "label", "rest"), page, ["start"], Captions, "start long, label string, title string, x double, y double")


class Merged(Fold):
    """Headings and environments in document order to the entries shown: a heading once an environment follows it."""

    def __init__(self):
        self.waiting: list[dict | None] = [None, None]
        self.shown = 0

    def step(self, e: dict) -> Iterator[tuple]:
        if e["heading"]:
            depth = min(e["depth"], 1)
            self.waiting[depth] = e
            if depth == 0:
                self.waiting[1], self.shown = None, 0
            else:
                self.shown = min(self.shown, 1)
            return
        for depth, head in enumerate(self.waiting):
            if head:
                yield head["id"], True, depth
                self.shown = depth + 1
        self.waiting = [None, None]
        yield e["id"], False, self.shown


def merged_structure(entries: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, id, heading, depth) of entries (doc, id, page, y, heading, depth); y points up, headings come first at equal y."""
    rows = entries.select(doc, "id", "page", "y", "heading", "depth")
    return fold(rows, [doc], ["page", F.desc("y"), F.desc("heading"), "id"], Merged, "id long, heading boolean, depth int")


class Rects(Fold):
    """Boxes of a match, in order, to one rectangle a visual line."""

    def __init__(self):
        self.box: list[float] | None = None

    def step(self, c: dict) -> Iterator[tuple]:
        if c["w"] <= 0 or c["h"] <= 0:
            return
        p = self.box
        if p and abs(p[1] + p[3] / 2 - (c["y"] + c["h"] / 2)) < c["h"] * 0.6 and c["x"] >= p[0] - c["h"] * 0.5:
            right, top = max(p[0] + p[2], c["x"] + c["w"]), max(p[1] + p[3], c["y"] + c["h"])
            x, y = min(p[0], c["x"]), min(p[1], c["y"])
            self.box = [x, y, right - x, top - y]
            return
        if p:
            yield tuple(p)
        self.box = [c["x"], c["y"], c["w"], c["h"]]

    def finish(self) -> Iterator[tuple]:
        if self.box:
            yield tuple(self.box)


def match_rects(matches: DataFrame, chars: DataFrame, page: str) -> DataFrame:
    """Rectangles (page, match, x, y, w, h) of matches (page, match, start, len) over characters (page, at, x, y, w, h)."""
    rows = matches.join(chars, page).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("len")))
    return fold(rows.select(page, "match", "at", *"xywh"), [page, "match"], ["at"], Rects, "x double, y double, w double, h double")


def anchor_starts(anchors: DataFrame, chars: DataFrame, page: str) -> DataFrame:
    """Adds start to anchors (page, anchor, ax, ay): the first character of the nearest line at or below each, null if there is none.

    Characters left of the anchor's own x don't count. The nearest top decides the line, then the first character near it.
    """
    gap = F.col("ay") - (F.col("y") + F.col("h"))
    seen = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("ax").isNull() | (F.col("x") >= F.col("ax") - ANCHOR_LEFT)) & (gap >= -ANCHOR_ABOVE)
    rows = anchors.join(chars.select(page, "at", *"xywh"), page).where(seen).withColumn("gap", gap)
    nearest = F.min("gap").over(W.partitionBy(page, "anchor"))
    found = rows.withColumn("nearest", nearest).where(F.col("gap") <= F.col("nearest") + ANCHOR_LINE).groupBy(page, "anchor").agg(F.min("at").alias("start"))
    return anchors.join(found, [page, "anchor"], "left")


def anchor_text(raw: Column, start: Column) -> Column:
    """The text from an anchor on; null if it is blank."""
    text = F.substring(raw, start + 1, F.lit(ANCHOR_TEXT))
    return F.when(F.btrim(text, F.lit(" \t\r\n\x0b\x0c\x85\xa0")) != "", text)


def nearest_line(anchors: DataFrame, lines: DataFrame, page: str, fits: Column) -> DataFrame:
    """Anchors (page, anchor, ax, ay, counter) with the nearest line (page, start, text, x, y) in height that fits; of equals the first."""
    rows = anchors.join(lines, page).where(fits)
    hit = F.min_by(F.struct("text", "x", "y"), F.struct(F.abs(F.col("y") - F.col("ay")), F.col("start"), F.col("text"))).alias("hit")
    best = rows.groupBy(page, "anchor").agg(hit)
    return anchors.join(best, [page, "anchor"], "left").select(*anchors.columns, "hit.text", F.col("hit.x").alias("line_x"), F.col("hit.y").alias("line_y"))


def opens_near(text: Column, counter: Column) -> Column:
    """Whether a line opens with the counter and then a letter, and begins in the anchor's column."""
    rest = F.ltrim(F.substring(F.ltrim(text), F.char_length(counter) + 1, F.char_length(text)), F.lit(".:) "))
    opens = F.startswith(F.ltrim(text), counter) & rest.rlike(r"\A\p{L}")
    return opens & (F.col("ax").isNull() | (F.abs(F.col("x") - F.col("ax")) <= HEADING_LEFT))


class Crop(Fold):
    """Runs of a column from the anchor downward to the bottom of what a preview shows."""

    def __init__(self):
        self.bottom: float | None = None
        self.done, self.page = False, None

    def step(self, r: dict) -> Iterator[tuple]:
        self.page = r
        if self.done or r["y"] is None:
            return iter(())
        tall, top = r["median"], r["y_top"]
        low, high = max(r["y"], 0.0), min(r["y"] + r["h"], r["page_h"])
        if high > top + tall:
            return iter(())
        if self.bottom is None:
            self.bottom = max(low, top - r["max_h"])
        elif (self.bottom - high > 2.2 * tall and top - self.bottom >= r["min_h"]) or top - low > r["max_h"]:
            self.done = True
        else:
            self.bottom = min(self.bottom, low)
        return iter(())

    def finish(self) -> Iterator[tuple]:
        p = self.page
        bottom = max(p["y_top"] - p["min_h"], 0.0) if self.bottom is None else self.bottom
        yield (bottom,)


def preview_crops(previews: DataFrame, runs: DataFrame, page: str) -> DataFrame:
    """Crops (page, x, y, w, h) of previews (page, page_w, page_h, ay, low, high) of a column [low, high] below an anchor's height.

    30 points above the anchor show. Runs are taken downward until a gap of 2.2 lines, once 90 points are shown, or until the
    crop is as high as it may be.
    """
    at = F.least(F.greatest(F.lit(0.0), F.coalesce("ay", "page_h")), F.col("page_h"))
    rows = previews.withColumn("y_top", F.least(at + 30.0, F.col("page_h"))).withColumn("min_h", F.least(F.lit(90.0), F.col("page_h"))).withColumn("max_h", F.least(clamp(F.col("page_h") * 0.32, 120.0, 400.0), F.col("page_h")))
    seen = (F.col("r.w") > 0) & (F.col("r.h") > 0) & (F.col("r.y") <= F.col("p.y_top")) & (F.col("r.x") + F.col("r.w") > F.col("p.low")) & (F.col("r.x") < F.col("p.high"))
    joined = rows.alias("p").join(runs.alias("r"), (F.col(f"p.{page}") == F.col(f"r.{page}")) & seen, "left").select("p.*", F.col("r.y").alias("y"), F.col("r.h").alias("h"))
    joined = joined.withColumn("median", F.coalesce(F.percentile(F.greatest("h", F.lit(1.0)), 0.5).over(W.partitionBy(page)), F.lit(11.0)))
    bottoms = fold(joined, [page], [F.desc("y"), "h"], Crop, "bottom double")
    out, left, right = rows.join(bottoms, page), F.greatest(F.col("low") - 4, F.lit(0.0)), F.least(F.col("high") + 4, F.col("page_w"))
    low, high = F.greatest(F.col("bottom") - 4, F.lit(0.0)), F.least(F.col("y_top") + 4, F.col("page_h"))
    return out.select(page, left.alias("x"), low.alias("y"), F.greatest(right - left, F.lit(1.0)).alias("w"), F.greatest(high - low, F.lit(1.0)).alias("h"))


def preview_texts(crops: DataFrame, runs: DataFrame, page: str, most: int = 400) -> DataFrame:
    """Text (page, text) of the runs (page, start, text, x, y, w, h) that meet a crop, in order, joined by spaces and cut.

    Only so many runs are gathered as the cut can hold, of one character and a space at least.
    """
    meets = (F.col("r.x") + F.col("r.w") > F.col("c.x")) & (F.col("r.x") < F.col("c.x") + F.col("c.w")) & (F.col("r.y") + F.col("r.h") > F.col("c.y")) & (F.col("r.y") < F.col("c.y") + F.col("c.h"))
    rows = crops.alias("c").join(runs.alias("r"), (F.col(f"c.{page}") == F.col(f"r.{page}")) & meets).select(F.col(f"c.{page}").alias(page), "r.start", "r.text")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(page).orderBy("start"))).where(F.col("n") <= most)
    held = rows.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("t"))
    return held.select(page, F.substring(F.array_join(F.transform("t", lambda t: t["text"]), " "), 1, most).alias("text"))


def figure_crops(figures: DataFrame, runs: DataFrame, page: str, body: float = 0.55, least: float = 60.0, most: float = 0.75, padding: float = 4.0) -> DataFrame:
    """Crops (page, figure, x, y, w, h) of what lies above captions (page, figure, page_w, page_h, cy, low, high): up to the first
    run above as wide as prose, `body` of the column, but neither lower nor higher than may be."""
    at = F.least(F.greatest(F.lit(0.0), F.col("cy")), F.col("page_h"))
    rows = figures.withColumn("cy", at)
    in_column = (F.col("rh") > 0) & (F.col("rx") + F.col("rw") > F.col("low")) & (F.col("rx") < F.col("high"))
    boxes = runs.select(page, *[F.col(c).alias(f"r{c}") for c in "xywh"])
    near = rows.join(boxes, page, "left")
    tops = near.groupBy(page, "figure").agg(F.max(F.when(in_column & F.col("ry").between(F.col("cy") - 1, F.col("cy") + 1), F.col("ry") + F.col("rh"))).alias("t"))
    rows = rows.join(tops, [page, "figure"]).withColumn("top", F.greatest("cy", F.coalesce("t", "cy"))).drop("t")
    wide = in_column & (F.col("ry") > F.col("top")) & (F.col("rw") >= body * F.greatest(F.col("high") - F.col("low"), F.lit(1.0)))
    ends = rows.join(boxes, page, "left").groupBy(page, "figure").agg(F.min(F.when(wide, F.col("ry"))).alias("e"))
    rows = rows.join(ends, [page, "figure"]).withColumn("ceiling", F.coalesce("e", "page_h"))
    shortest, tallest = F.least(F.lit(least), F.col("page_h")), F.least(F.col("page_h") * most, F.col("page_h"))
    tall = F.greatest(shortest, F.least(tallest, F.col("ceiling") - F.col("top")))
    tall = F.when(F.col("top") + tall > F.col("page_h"), F.greatest(F.col("page_h") - F.col("top"), shortest)).otherwise(tall)
    left, right = F.greatest(F.col("low") - padding, F.lit(0.0)), F.least(F.col("high") + padding, F.col("page_w"))
    bottom = F.greatest(F.col("top") - padding, F.lit(0.0))
    high = F.least(bottom + tall + padding, F.col("page_h"))
    return rows.select(page, "figure", left.alias("x"), bottom.alias("y"), F.greatest(right - left, F.lit(1.0)).alias("w"), F.greatest(high - bottom, F.lit(1.0)).alias("h"))


def rect_texts(rects: DataFrame, chars: DataFrame, page: str) -> DataFrame:
    """Adds text to rectangles (page, rect, x, y, w, h): the characters (page, at, ch, ..) that overlap it, in order."""
    box = chars.select(page, "at", "ch", F.struct(*"xywh").alias("b")).where((F.col("b.w") > 0) & (F.col("b.h") > 0))
    meets = (F.col("b.x") + F.col("b.w") > F.col("x")) & (F.col("b.x") < F.col("x") + F.col("w")) & (F.col("b.y") + F.col("b.h") > F.col("y")) & (F.col("b.y") < F.col("y") + F.col("h"))
    found = rects.join(box, page).where(meets).groupBy(page, "rect").agg(F.sort_array(F.collect_list(F.struct("at", "ch"))).alias("t"))
    return rects.join(found.select(page, "rect", F.array_join(F.transform("t", lambda t: t["ch"]), "").alias("text")), [page, "rect"], "left")


def link_letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def without_runaways(links: DataFrame, page: str) -> DataFrame:
    """Links (page, rect, uri, x, y, w, h, page_h, text) without the rectangles that a scope left open by mistake gave an address.

    An address of many rectangles over nearly half of its page keeps those whose text is in it, or has it; if none is, the
    narrowest with text, then the shortest text, then the first; if none has text, all. Links without address all stay.
    """
    own, of = F.coalesce(link_letters(F.col("text")), F.lit("")), W.partitionBy(page, "uri")
    rows = links.withColumn("own", own).withColumn("in_uri", link_letters(F.col("uri")))
    match = (F.octet_length("own") >= 5) & (F.contains("in_uri", F.col("own")) | F.contains("own", F.col("in_uri")))
    span = F.max(F.col("y") + F.col("h")).over(of) - F.min("y").over(of)
    bad = F.col("uri").isNotNull() & (F.count("*").over(of) >= RUNAWAY_RECTS) & (span >= F.greatest("page_h", F.lit(1.0)) * RUNAWAY_SPAN) & (F.max(F.col("own") != "").over(of))
    rows = rows.withColumn("bad", bad).withColumn("match", F.coalesce(match, F.lit(False))).withColumn("some", F.max("match").over(of))
    narrow = F.row_number().over(of.orderBy(F.col("own") == "", "w", F.octet_length("own"), "rect"))
    keep = ~F.col("bad") | F.when(F.col("some"), F.col("match")).otherwise(narrow == 1)
    return rows.withColumn("keep", keep).where("keep").select(*links.columns)


def links_of(annotations: DataFrame, web: DataFrame, cited: DataFrame) -> DataFrame:
    """Links (page, rect, uri, x, y, w, h) of three sources, with their priority: annotations, addresses in text, identifiers."""
    out = annotations.withColumn("priority", F.lit(0))
    for n, more in enumerate((web, cited), 1):
        out = out.unionByName(more.withColumn("priority", F.lit(n)))
    return out


def outline_entries(nodes: DataFrame, deepest: int = 64) -> DataFrame:
    """Entries (node, depth, label, page, y, path) of a tree of bookmarks (node, parent, ord, title, page, y) with a page.

    One join for each level from the roots down, as deep as the tree is and `deepest` at most; nodes in a cycle hang on no root
    and never come. path orders siblings by ord, parents before children. Depths beyond 1 count as 1.
    """
    level = nodes.where("parent IS NULL").select("node", "title", "page", "y", F.lit(0).alias("depth"), F.array("ord").alias("path"))
    every, rest = level, nodes.where("parent IS NOT NULL")
    for depth in range(1, deepest + 1):
        level = level.select(F.col("node").alias("parent"), F.col("path").alias("above")).join(rest, "parent")
        level = level.select("node", "title", "page", "y", F.lit(depth).alias("depth"), F.concat("above", F.array("ord")).alias("path"))
        if level.isEmpty():
            break
        every = every.union(level)
    label = F.when(F.trim("title") == "", "Untitled").otherwise(F.trim("title"))
    return every.where(F.col("page").isNotNull()).select("node", F.least("depth", F.lit(1)).alias("depth"), label.alias("label"), "page", "y", "path")
