"""Page geometry: y points up in page space and down on screen; rotations are multiples of 90 degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the zoom control, and render scales.
ZOOMS = [0.25, 0.33, 0.5, 0.67, 0.75, 0.9, 1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0]
SCALES = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0]


def turned(rotation: Column) -> Column:
    return rotation.isin(90, 270)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def user_to_display(x: Column, y: Column, w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of an unrotated w x h page on the page as shown; both with y up."""
    dx = F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, h - y).otherwise(x)
    dy = F.when(rotation == 90, w - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y)
    return dx, dy


def display_to_user(dx: Column, dy: Column, w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    """The inverse: w and h are those of the unrotated page."""
    x = F.when(rotation == 90, w - dy).when(rotation == 180, w - dx).when(rotation == 270, dy).otherwise(dx)
    y = F.when(rotation == 90, dx).when(rotation == 180, h - dy).when(rotation == 270, h - dx).otherwise(dy)
    return x, y


def page_to_css(x: Column, y: Column, w: Column, h: Column, rotation: Column, zoom: Column) -> tuple[Column, Column]:
    """A page point in screen pixels from the page's top left corner."""
    cx = F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, h - y).otherwise(x)
    cy = F.when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, w - x).otherwise(h - y)
    return cx * zoom, cy * zoom


def css_size(w: Column, h: Column, rotation: Column, zoom: Column) -> tuple[Column, Column]:
    return F.when(turned(rotation), h).otherwise(w) * zoom, F.when(turned(rotation), w).otherwise(h) * zoom


def fit_page(w: Column, h: Column, rotation: Column, view_w: Column, view_h: Column) -> Column:
    cw, ch = css_size(w, h, rotation, F.lit(1.0))
    return F.least(view_w / cw, view_h / ch)


def overlap(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    """Length that two spans share."""
    return F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))


def iou(a: dict, b: dict) -> Column:
    """Intersection over union of rectangles given as dicts of columns x, y, w, h; 0 if they don't meet."""
    common = overlap(a["x"], a["w"], b["x"], b["w"]) * overlap(a["y"], a["h"], b["y"], b["h"])
    return F.when(common > 0, common / (a["w"] * a["h"] + b["w"] * b["h"] - common)).otherwise(0.0)


def round_away(x: Column) -> Column:
    """Halves go away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def rect_to_tile(x: Column, y: Column, w: Column, h: Column, page_h: Column, scale_milli: Column) -> Column:
    """Pixel tile of a rectangle with y up, at a scale in thousandths."""
    s = scale_milli / 1000.0
    at = lambda v: F.greatest(F.lit(0).cast("long"), round_away(v * s).cast("long"))
    size = lambda v: clamp(round_away(v * s).cast("long"), 1, 4096)
    return F.struct(at(x).alias("x"), at(page_h - y - h).alias("y"), size(w).alias("w"), size(h).alias("h"))


def wheel_zoom(delta: Column, mode: Column, view_h: Column) -> Column:
    unit = F.when(mode == 1, F.lit(16.0)).when(mode == 2, F.greatest(F.lit(1.0), view_h)).otherwise(1.0)
    return F.exp(-clamp(delta * unit, -48.0, 48.0) * 0.0022)


def scale_bucket(scale: Column) -> Column:
    """The smallest render scale that is enough, else the largest."""
    fit = F.filter(F.array(*[F.lit(s) for s in SCALES]), lambda s: s >= scale - 1e-9)
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(SCALES[-1]))


def zoom_step(zoom: Column, up: bool) -> Column:
    """The next step of the ladder beyond a hair, else its end."""
    ladder = F.array(*[F.lit(z) for z in ZOOMS])
    if up:
        return F.coalesce(F.get(F.filter(ladder, lambda z: z > zoom + 1e-6), F.lit(0)), F.lit(ZOOMS[-1]))
    return F.coalesce(F.try_element_at(F.filter(ladder, lambda z: z < zoom - 1e-6), F.lit(-1)), F.lit(ZOOMS[0]))


def anchored_scroll(old: dict, new: dict, scroll: Column, at: Column, low: str, size: str) -> Column:
    """Scroll position along one axis that keeps what lies `at` pixels into the view there: the same part of the page before and
    after. old and new are the page's boxes, dicts of columns; beyond the page its nearest edge holds."""
    part = clamp((scroll + at - old[low]) / old[size], 0.0, 1.0)
    return F.greatest(F.lit(0.0), new[low] + part * new[size] - at)


def view_fraction(page: dict, view: dict) -> Column:
    """Struct x, y, w, h: what part of a page box the view shows, as parts of the page; null if none. Dicts of columns x, y, w, h."""
    x, y = F.greatest(view["x"], page["x"]), F.greatest(view["y"], page["y"])
    right, bottom = F.least(view["x"] + view["w"], page["x"] + page["w"]), F.least(view["y"] + view["h"], page["y"] + page["h"])
    shown = (page["w"] != 0) & (page["h"] != 0) & (right > x) & (bottom > y)
    part = ((x - page["x"]) / page["w"], (y - page["y"]) / page["h"], (right - x) / page["w"], (bottom - y) / page["h"])
    return F.when(shown, F.struct(*[c.alias(n) for c, n in zip(part, "xywh", strict=True)]))


def view_origin(page: dict, view: dict) -> tuple[Column, Column]:
    """Where the view's corner lies in a page's box, as parts of it, outside it too."""
    return (view["x"] - page["x"]) / page["w"], (view["y"] - page["y"]) / page["h"]


def scroll_to(page: dict, x: Column, y: Column) -> tuple[Column, Column]:
    """The scroll position (left, top) that puts this part of a page at the view's corner."""
    return page["x"] + x * page["w"], page["y"] + y * page["h"]


def page_y(content_y: Column, top: Column, zoom: Column, page_h: Column) -> Column:
    """Page space y, up, of a scroll offset."""
    return page_h - (content_y - top) / zoom


def is_tiled(w: Column, h: Column, rotation: Column, scale_milli: Column, threshold: int = 4_000_000) -> Column:
    """Whether a page rendered at this scale has more pixels than one picture may."""
    pixels = lambda v: F.greatest(F.lit(1).cast("long"), F.floor(v * scale_milli / 1000 + 0.5).cast("long"))
    return pixels(F.when(turned(rotation), h).otherwise(w)) * pixels(F.when(turned(rotation), w).otherwise(h)) > threshold


def follow(position: Column, start: Column, view: Column, total: Column) -> Column:
    """Scroll target that keeps a position within the middle half of the view, moving no more than that takes."""
    margin = view * 0.25
    moved = F.when(position - start < margin, position - margin).when(position - start > view - margin, position - view + margin).otherwise(start)
    return F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), total - view), moved))


#: Largest sizes of a preview, and of one that fits its content with its frame and least width.
PREVIEW, FITTED, FRAME, LEAST_FITTED = (420, 320), (504, 384), (26, 42), 140


def preview_size(view_w: Column, view_h: Column, content_w: Column, content_h: Column) -> tuple[Column, Column]:
    """Width and height of a preview inside a view; null content: the plain size, else as large as what it shows."""
    free_w, free_h = F.greatest(F.lit(0.0), view_w - 16), F.greatest(F.lit(0.0), view_h - 16)
    most = F.least(F.lit(float(FITTED[0])), free_w)
    w = F.least(most, F.greatest(F.least(F.lit(float(LEAST_FITTED)), most), F.ceil(content_w + FRAME[0]).cast("double")))
    fitted = content_h * F.least(F.lit(1.0), F.greatest(F.lit(1.0), w - FRAME[0]) / content_w)
    h = F.least(F.lit(float(FITTED[1])), free_h, F.ceil(fitted + FRAME[1]).cast("double"))
    plain = content_w.isNull()
    return F.when(plain, F.least(F.lit(float(PREVIEW[0])), free_w)).otherwise(w), F.when(plain, F.least(F.lit(float(PREVIEW[1])), free_h)).otherwise(h)


def beside(first: Column, second: Column, size: Column, view: Column) -> Column:
    """One coordinate of a box that should begin at first, or at second where it would leave the view; held 8 pixels inside."""
    start = F.when(first + size > view - 8, second).otherwise(first)
    return F.greatest(F.lit(8.0), F.least(start, view - size - 8))


def popover(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column, view_w: Column, view_h: Column) -> tuple[Column, Column]:
    """Left and top of a w x h box at an anchor's right, else its left; level with its top, else ending with its bottom."""
    return beside(right + 10, left - w - 10, w, view_w), beside(top, bottom - h, h, view_h)
