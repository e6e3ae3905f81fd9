"""What a viewer shows of documents: highlights under a drag, ink, tiles, thumbnails, notes and tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions import geometry as geo
from papyra.operators import layout

#: Room around the view whose tiles are shown, thumbnail width, padding and gap, and preview characters of a note.
TILE_MARGIN, THUMB, SLOT, GAP, NOTE, TABS = 768, 148, 30, 10, 220, 30


def highlights(drags: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Rows (key, quads, x, y, w, h) of drag rectangles (key, dx, dy, dw, dh) over text runs (key, at, x, y, w, h).

    A run counts if the drag covers a point of its width and 35 % of its height; its quad is as wide as the drag and as high
    as the run. A drag over no run gives no row.
    """
    rows = drags.join(runs, key)
    low, right = F.greatest("dx", "x"), F.least(F.col("dx") + F.col("dw"), F.col("x") + F.col("w"))
    tall = F.least(F.col("dy") + F.col("dh"), F.col("y") + F.col("h")) - F.greatest("dy", "y")
    rows = rows.where((right - low >= 1) & (tall >= F.col("h") * 0.35)).select(key, "at", low.alias("qx"), F.col("y").alias("qy"), (right - low).alias("qw"), F.col("h").alias("qh"))
    box = [F.min("qx").alias("x"), F.min("qy").alias("y"), (F.max(F.col("qx") + F.col("qw")) - F.min("qx")).alias("w"), (F.max(F.col("qy") + F.col("qh")) - F.min("qy")).alias("h")]
    return rows.groupBy(key).agg(F.count("*").alias("quads"), *box)


def decimated(points: Column, least: float = 1.2) -> Column:
    """An array of points x, y without those that lie no more than `least` from the last one kept."""
    kind = "array<struct<x:double,y:double>>"

    def step(state, p):
        last = F.try_element_at(state, F.lit(-1))
        far = last.isNull() | (F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > least)
        return F.when(far, F.concat(state, F.array(p))).otherwise(state)

    return F.aggregate(points.cast(kind), F.array().cast(kind), step)


def visible_tiles(pictures: DataFrame, key: str, tile: int) -> DataFrame:
    """Tiles (key, x, y, w, h) of pictures (key, width, height) within the view's device rectangle (vx, vy, vw, vh) of the same row
    and a margin; none where the view misses the picture. A row makes its own tiles, only those in view: nothing is joined."""
    x0, y0 = F.greatest(F.lit(0.0), F.col("vx") - TILE_MARGIN), F.greatest(F.lit(0.0), F.col("vy") - TILE_MARGIN)
    x1, y1 = F.least(F.col("width"), F.col("vx") + F.col("vw") + TILE_MARGIN), F.least(F.col("height"), F.col("vy") + F.col("vh") + TILE_MARGIN)
    meets = (x1 > 0) & (x0 < F.col("width")) & (y1 > 0) & (y0 < F.col("height"))
    return layout.tiles(pictures.where(meets), key, tile, lambda x, w: (x + w >= x0) & (x <= x1), lambda y, h: (y + h >= y0) & (y <= y1))


def thumbnails(pages: DataFrame) -> DataFrame:
    """Adds slot height and top to pages (doc, src, width, height, rotation) shown as thumbnails of equal width."""
    w, h = F.when(geo.turned(F.col("rotation")), F.col("height")).otherwise(F.col("width")), F.when(geo.turned(F.col("rotation")), F.col("width")).otherwise(F.col("height"))
    rows = pages.withColumn("slot", h / w * THUMB + SLOT)
    before = W.partitionBy("doc").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("top", 12 + F.coalesce(F.sum(F.col("slot") + GAP).over(before), F.lit(0.0)))


def notes(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations (page_id, at, quote) of pages (doc, page_id, at, src) in reading order: (doc, row, page from 1, src, preview)."""
    rows = pages.select("doc", "page_id", F.col("at").alias("page_at"), "src").join(annotations, "page_id")
    cut = F.concat(F.rtrim(F.substring("quote", 1, NOTE)), F.lit("…"))
    order = W.partitionBy("doc").orderBy("page_at", "at")
    return rows.select("doc", F.row_number().over(order).alias("row"), (F.col("page_at") + 1).alias("page"), F.coalesce("src", "page_at").alias("src"), F.when(F.char_length("quote") > NOTE, cut).otherwise(F.col("quote")).alias("preview"))


def opened(requests: DataFrame, tabs: DataFrame, resume: DataFrame) -> DataFrame:
    """What becomes of requests (owner, path, pages) to open: focus a tab of the path, refuse beyond TABS tabs, or open at a page.

    tabs (owner, id, path), of which the first of a path is meant; resume (owner, path, page) is where it was left, which
    holds only within the document.
    """
    count = tabs.groupBy("owner").agg(F.count("*").alias("n"))
    first = tabs.groupBy("owner", "path").agg(F.min("id").alias("tab"))
    rows = requests.join(first, ["owner", "path"], "left").join(count, "owner", "left").join(resume, ["owner", "path"], "left")
    action = F.when(F.col("tab").isNotNull(), "focus").when(F.coalesce("n", F.lit(0)) >= TABS, "refuse").otherwise("open")
    page = F.when(action == "open", F.when(F.col("page") < F.col("pages"), F.col("page")).otherwise(0))
    return rows.select("owner", "path", action.alias("action"), "tab", page.alias("page"))


def selected(runs: DataFrame, key: str) -> DataFrame:
    """Runs (key, at, text) cut to a selection (first, start, last, end: runs and offsets); empty ones go. Null offsets take all."""
    start = F.when(F.col("at") == F.col("first"), F.coalesce("start", F.lit(0))).otherwise(0)
    end = F.when(F.col("at") == F.col("last"), F.coalesce("end", F.char_length("text"))).otherwise(F.char_length("text"))
    rows = runs.where(F.col("at").between(F.col("first"), F.col("last"))).withColumn("text", F.substring("text", start + 1, F.greatest(end - start, F.lit(0))))
    return rows.where(F.col("text") != "").select(key, "at", "text")


def placed_image(page_w: Column, page_h: Column, natural_w: Column, natural_h: Column) -> Column:
    """Rectangle of a new picture: at most 40 % of the page's width and three quarters of its own, centred."""
    w = F.least(page_w * 0.4, natural_w * 0.75)
    h = w * (natural_h / natural_w)
    return F.struct(((page_w - w) / 2).alias("x"), ((page_h - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def library_line(roots: Column, scanning: Column, indexed: Column, text_indexed: Column, text_total: Column) -> Column:
    """The line about a library's state. Its words are fixed values."""
    text = lambda c: c.cast("string")
    done = F.concat(text(indexed), F.when(indexed == 1, F.lit(" paper")).otherwise(F.lit(" papers")), F.lit(" in the library."))
    waiting = F.concat(F.lit("Indexing "), text(text_indexed), F.lit(" of "), text(text_total), F.lit(" — searching what is ready so far."))
    return F.when(roots == 0, "").when(scanning, F.concat(F.lit("Scanning… "), text(indexed), F.lit(" papers found so far."))).when(text_total > text_indexed, waiting).otherwise(done)


def file_arguments(arguments: Column, base: Column, files: Column) -> Column:
    """Paths that a command line names: without its first word, blanks, flags and what is no file; relative ones below base."""
    rest = F.filter(F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0))), lambda a: (a != "") & ~F.startswith(a, F.lit("-")))
    whole = F.transform(rest, lambda a: F.when(F.startswith(a, F.lit("/")), a).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), a)))
    return F.filter(whole, lambda a: F.array_contains(files, a))
