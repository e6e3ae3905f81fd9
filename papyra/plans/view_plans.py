"""The viewer: highlights, ink, tiles, thumbnails, scroll positions, previews, notes, tabs and status lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions import geometry as geo
from papyra.operators import view
from papyra.plans.library_plans import BOX_SQL, SHEETS, SHEETS_SQL, boxes
from papyra.registry import query, table


@query("drag_highlights", f"""WITH b AS ({BOX_SQL}), q AS (SELECT l_orderkey AS k, greatest(5.0, x) AS qx, y AS qy, least(45.0, x + w) - greatest(5.0, x) AS qw, h AS qh, least(31.0, y + h) - greatest(6.0, y) AS tall FROM b)
    SELECT k AS page, count(*) AS quads, min(qx) AS x, min(qy) AS y, max(qx + qw) - min(qx) AS w, max(qy + qh) - min(qy) AS h FROM q WHERE qw >= 1 AND tall >= qh * 0.35 GROUP BY k""")
def drag_highlights(spark, sf_dir):
    """CMP-01: one drag on each page."""
    runs = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("at"), *"xywh")
    drags = runs.select("page").distinct().select("page", F.lit(5.0).alias("dx"), F.lit(6.0).alias("dy"), F.lit(40.0).alias("dw"), F.lit(25.0).alias("dh"))
    return view.highlights(drags, runs, "page")


@query("ink_strokes")
def ink_strokes(spark, sf_dir):
    """CMP-02: which points stay depends on those kept before; a stroke for each order, by line."""
    points = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 20).alias("y"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(points.alias("p"))  # a few lines an order
    return rows.select("l_orderkey", view.decimated(F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("points"))


@query("straight_strokes", "SELECT p_partkey, list_transform(range(0, p_size, 2), lambda i: i::DOUBLE) AS x FROM part")
def straight_strokes(spark, sf_dir):
    """CMP-02 on points 0.7 apart, where every other one stays."""
    points = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.struct((i * 0.7).alias("x"), F.lit(0.0).alias("y")))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", view.decimated(points).alias("p"))
    return rows.select("p_partkey", F.transform("p", lambda p: F.round(p["x"] / 0.7)).alias("x"))


PICTURE_SQL = "SELECT p_partkey, p_size * 200 AS width, p_size * 150 + 7 AS height, (p_partkey % 3000)::DOUBLE AS vx, (p_partkey % 2000 - 500)::DOUBLE AS vy FROM part"


@query("visible_tiles", f"""WITH t AS (SELECT *, unnest(range(0, width, 1024)) AS x FROM (SELECT *, unnest(range(0, height, 1024)) AS y FROM ({PICTURE_SQL}))),
    b AS (SELECT p_partkey, x, y, least(1024, width - x) AS w, least(1024, height - y) AS h, greatest(0, vx - 768) AS x0, greatest(0, vy - 768) AS y0, least(width, vx + 800 + 768) AS x1, least(height, vy + 600 + 768) AS y1, width, height FROM t)
    SELECT p_partkey, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM b WHERE x1 > 0 AND x0 < width AND y1 > 0 AND y0 < height AND x + w >= x0 AND x <= x1 AND y + h >= y0 AND y <= y1""")
def visible_tiles(spark, sf_dir):
    """CMP-06."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 200 AS width", "p_size * 150 + 7 AS height", "p_partkey % 3000 AS vx", "p_partkey % 2000 - 500 AS vy")
    pictures = rows.select("p_partkey", "width", "height", F.col("vx").cast("double").alias("vx"), F.col("vy").cast("double").alias("vy"), F.lit(800.0).alias("vw"), F.lit(600.0).alias("vh"))
    return view.visible_tiles(pictures, "p_partkey", 1024)


@query("tiling_decisions", f"SELECT doc, src, greatest(1, floor(width * 20.0 + 0.5)) * greatest(1, floor(height * 20.0 + 0.5)) > 4000000 AS tiled FROM (SELECT {SHEETS_SQL})")
def tiling_decisions(spark, sf_dir):
    """CMP-07."""
    rows = table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", "))
    return rows.select("doc", "src", geo.is_tiled(F.col("width"), F.col("height"), F.lit(0), F.lit(20000.0)).alias("tiled"))


@query("thumbnail_layout", f"""WITH t AS (SELECT doc, src, CASE WHEN src % 4 IN (1, 3) THEN width / height ELSE height / width END * 148 + 30 AS slot FROM (SELECT {SHEETS_SQL}))
    SELECT doc, src, round(slot, 6) AS slot, round(12 + coalesce(sum(slot + 10) OVER (PARTITION BY doc ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS top FROM t""")
def thumbnail_layout(spark, sf_dir):
    """CMP-08."""
    rows = table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", ")).withColumn("rotation", F.col("src") % 4 * 90)
    return view.thumbnails(rows).select("doc", "src", F.round("slot", 6).alias("slot"), F.round("top", 6).alias("top"))




def page_box():
    return {c: F.col(f"p{c}") for c in "xywh"}


def view_box():
    return {"x": F.col("vx"), "y": F.col("vy"), "w": F.lit(800.0), "h": F.lit(600.0)}


SCREEN = ["p_brand AS doc", "p_partkey AS src", "cast(p_size * 3 as double) AS px", "cast(p_partkey % 211 * 9 as double) AS py", "cast(p_size * 20 as double) AS pw", "cast(p_partkey % 7 * 100 as double) AS ph", "cast(p_partkey % 40 * 25 as double) AS vx", "cast(p_partkey % 90 * 20 as double) AS vy"]
SCREEN_SQL = "SELECT p_brand AS doc, p_partkey AS src, (p_size * 3)::DOUBLE AS px, (p_partkey % 211 * 9)::DOUBLE AS py, (p_size * 20)::DOUBLE AS pw, (p_partkey % 7 * 100)::DOUBLE AS ph, (p_partkey % 40 * 25)::DOUBLE AS vx, (p_partkey % 90 * 20)::DOUBLE AS vy FROM part"
SHOWN_SQL = f"""SELECT *, greatest(vx, px) AS x0, greatest(vy, py) AS y0, least(vx + 800, px + pw) AS x1, least(vy + 600, py + ph) AS y1 FROM ({SCREEN_SQL})"""


def screens(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*SCREEN)


@query("viewport_fractions", f"""SELECT doc, src, CASE WHEN s THEN round((x0 - px) / pw, 9) END AS x, CASE WHEN s THEN round((y0 - py) / ph, 9) END AS y, CASE WHEN s THEN round((x1 - x0) / pw, 9) END AS w, CASE WHEN s THEN round((y1 - y0) / ph, 9) END AS h,
    CASE WHEN ph > 0 THEN round((vx - px) / pw, 9) END AS origin_x, CASE WHEN ph > 0 THEN round((vy - py) / ph, 9) END AS origin_y, CASE WHEN ph > 0 THEN vx END AS back_x, CASE WHEN ph > 0 THEN vy END AS back_y
    FROM (SELECT *, ph > 0 AND x1 > x0 AND y1 > y0 AS s FROM ({SHOWN_SQL}))""")
def viewport_fractions(spark, sf_dir):
    """GEO-09: the part of a page that shows, the view's corner in page space, and the way back."""
    part, page = geo.view_fraction(page_box(), view_box()), {**page_box(), "h": F.nullif("ph", F.lit(0.0))}
    ox, oy = geo.view_origin(page, view_box())
    bx, by = geo.scroll_to(page, ox, oy)
    r = lambda c, n: F.round(c, 9).alias(n)
    there = F.col("ph") > 0
    return screens(spark, sf_dir).withColumn("f", part).select("doc", "src", *[r(F.col(f"f.{n}"), n) for n in "xywh"], r(F.when(there, ox), "origin_x"), r(oy, "origin_y"), F.when(there, F.round(bx, 6)).alias("back_x"), F.round(by, 6).alias("back_y"))


@query("last_visible_pages", f"SELECT doc, coalesce(max(src) FILTER (ph > 0 AND x1 > x0 AND y1 > y0), -1) AS page FROM ({SHOWN_SQL}) GROUP BY doc")
def last_visible_pages(spark, sf_dir):
    """CMP-09."""
    return screens(spark, sf_dir).groupBy("doc").agg(F.coalesce(F.max(F.when(geo.view_fraction(page_box(), view_box()).isNotNull(), F.col("src"))), F.lit(-1)).alias("page"))


@query("anchored_scrolls", f"""WITH s AS (SELECT doc, src, px, py, pw, ph, vx, vy FROM ({SCREEN_SQL}) WHERE ph > 0)
    SELECT doc, src, round(greatest(0, py * 2 + greatest(0, least(1, (vy + 100 - py) / ph)) * ph * 2 - 100), 6) AS top, round(greatest(0, px * 2 + greatest(0, least(1, (vx + 60 - px) / pw)) * pw * 2 - 60), 6) AS "left" FROM s""")
def anchored_scrolls(spark, sf_dir):
    """GEO-07: zoom to twice the size around a point of the view."""
    new = {k: c * 2 for k, c in page_box().items()}
    top = geo.anchored_scroll(page_box(), new, F.col("vy"), F.lit(100.0), "y", "h")
    left = geo.anchored_scroll(page_box(), new, F.col("vx"), F.lit(60.0), "x", "w")
    return screens(spark, sf_dir).where("ph > 0").select("doc", "src", F.round(top, 6).alias("top"), F.round(left, 6).alias("left"))


@query("follow_targets", f"""WITH s AS (SELECT doc, src, py AS pos, vy AS start FROM ({SCREEN_SQL})), m AS (SELECT *, CASE WHEN pos - start < 150 THEN pos - 150 WHEN pos - start > 450 THEN pos - 450 ELSE start END AS t FROM s)
    SELECT doc, src, greatest(0, least(1500.0 - 600, t))::DOUBLE AS target FROM m""")
def follow_targets(spark, sf_dir):
    """CMP-10."""
    return screens(spark, sf_dir).select("doc", "src", geo.follow(F.col("py"), F.col("vy"), F.lit(600.0), F.lit(1500.0)).alias("target"))


@query("wheel_zooms", """SELECT event_id, round(exp(-greatest(-48, least(48, (value - 20) * CASE event_id % 3 WHEN 1 THEN 16.0 WHEN 2 THEN greatest(1.0, (event_id % 900)::DOUBLE) ELSE 1.0 END)) * 0.0022), 9) AS factor, greatest(0.2, least(6.0, value / 10)) AS zoom FROM events""")
def wheel_zooms(spark, sf_dir):
    """GEO-08, CMP-19."""
    factor = geo.wheel_zoom(F.col("value") - 20, F.col("event_id") % 3, (F.col("event_id") % 900).cast("double"))
    return table(spark, sf_dir, "events", "event_id", "value").select("event_id", F.round(factor, 9).alias("factor"), geo.clamp(F.col("value") / 10, 0.2, 6.0).alias("zoom"))


@query("page_fits", f"SELECT doc, src, least((1000.0 - 40) / CASE WHEN src % 2 = 1 THEN height ELSE width END, (700.0 - 40) / CASE WHEN src % 2 = 1 THEN width ELSE height END)::DOUBLE AS page, ((1000.0 - 40) / CASE WHEN src % 2 = 1 THEN height ELSE width END)::DOUBLE AS width FROM (SELECT {SHEETS_SQL})")
def page_fits(spark, sf_dir):
    """GEO-06: zooms that fit a page, and its width, into the view less a margin of 20."""
    rows = table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", "))
    turn = (F.col("src") % 2 * 90).cast("int")
    fit = geo.fit_page(F.col("width"), F.col("height"), turn, F.lit(960.0), F.lit(660.0))
    return rows.select("doc", "src", fit.alias("page"), (960.0 / geo.css_size(F.col("width"), F.col("height"), turn, F.lit(1.0))[0]).alias("width"))


@query("crop_offsets", "SELECT p_partkey, (p_size - p_partkey % 5)::DOUBLE AS nx, (p_retailprice - p_partkey % 9)::DOUBLE AS ny, p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def crop_offsets(spark, sf_dir):
    """GEO-05: into the crop box and out again."""
    x, y, cx, cy = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey") % 5, F.col("p_partkey") % 9
    rows = table(spark, sf_dir, "part").select("p_partkey", (x - cx).alias("nx"), (y - cy).alias("ny"), cx.alias("cx"), cy.alias("cy"))
    return rows.select("p_partkey", "nx", "ny", (F.col("nx") + F.col("cx")).alias("x"), F.round(F.col("ny") + F.col("cy"), 6).alias("y"))


@query("rect_tiles", f"""SELECT l_orderkey, l_linenumber, greatest(0, floor(x * 2.5 + 0.5))::BIGINT AS tx, greatest(0, floor((50 - y - h) * 2.5 + 0.5))::BIGINT AS ty, greatest(1, least(4096, floor(w * 2.5 + 0.5)))::BIGINT AS tw, 30::BIGINT AS th FROM ({BOX_SQL})""")
def rect_tiles(spark, sf_dir):
    """GEO-12: rectangles with y up to pixel tiles at 2.5 times."""
    tile = geo.rect_to_tile(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(50.0), F.lit(2500.0))
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", tile.alias("t")).select("l_orderkey", "l_linenumber", *[F.col(f"t.{c}").alias(f"t{c}") for c in "xywh"])


@query("popovers", f"""WITH s AS (SELECT doc, src, px AS l, py AS t, px + 40 AS r, py + 12 AS b, 900.0::DOUBLE AS vw, 500.0::DOUBLE AS vh, pw, ph FROM ({SCREEN_SQL}) WHERE ph > 0),
    z AS (SELECT *, CASE WHEN src % 2 = 0 THEN 420.0 ELSE least(504.0, vw - 16, greatest(140.0, ceil(pw + 26))) END AS w FROM s),
    y AS (SELECT *, CASE WHEN src % 2 = 0 THEN 320.0 ELSE least(384.0, vh - 16, ceil(ph * least(1.0, (w - 26) / pw) + 42)) END AS h FROM z),
    p AS (SELECT *, CASE WHEN r + 10 + w > vw - 8 THEN l - w - 10 ELSE r + 10 END AS x, CASE WHEN t + h > vh - 8 THEN b - h ELSE t END AS y FROM y)
    SELECT doc, src, w::DOUBLE AS w, h::DOUBLE AS h, greatest(8, least(x, vw - w - 8))::DOUBLE AS x, greatest(8, least(y, vh - h - 8))::DOUBLE AS y FROM p""")
def popovers(spark, sf_dir):
    """GEO-21: previews of plain size and as large as their content, beside an anchor and inside the view."""
    rows = screens(spark, sf_dir).where("ph > 0")
    fits = F.col("src") % 2 == 1
    w, h = geo.preview_size(F.lit(900.0), F.lit(500.0), F.when(fits, F.col("pw")), F.when(fits, F.col("ph")))
    rows = rows.withColumn("w", w).withColumn("h", h)
    x, y = geo.popover(F.col("px"), F.col("py"), F.col("px") + 40, F.col("py") + 12, F.col("w"), F.col("h"), F.lit(900.0), F.lit(500.0))
    return rows.select("doc", "src", "w", "h", x.alias("x"), y.alias("y"))


@query("scroll_heights", f"SELECT doc, src, round(792 - (vy - py) / 1.5, 9) AS y FROM ({SCREEN_SQL})")
def scroll_heights(spark, sf_dir):
    """GEO-22."""
    return screens(spark, sf_dir).select("doc", "src", F.round(geo.page_y(F.col("vy"), F.col("py"), F.lit(1.5), F.lit(792.0)), 9).alias("y"))


@query("hoverable_links", "SELECT event_id, event_type AS kind FROM events WHERE event_type <> 'error'")
def hoverable_links(spark, sf_dir):
    """CMP-11: links of unknown target, here errors, are no hover targets."""
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", F.col("event_type").alias("kind"))


@query("size_batches", "SELECT p_brand AS doc, (64 + 128 * ((src - 64) // 128))::BIGINT AS first, count(*) AS pages FROM (SELECT p_brand, p_partkey AS src FROM part) WHERE src >= 64 GROUP BY ALL")
def size_batches(spark, sf_dir):
    """CMP-12: pages from 64 on are asked for in batches of 128."""
    rows = table(spark, sf_dir, "part").where("p_partkey >= 64")
    return rows.groupBy(F.col("p_brand").alias("doc"), (64 + 128 * F.floor((F.col("p_partkey") - 64) / 128)).cast("long").alias("first")).agg(F.count("*").alias("pages"))


@query("sizes_hydrated", """SELECT p_brand AS doc, p_partkey AS at, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_partkey % 50 < 30 THEN (p_partkey % 50 + 100)::DOUBLE ELSE p_retailprice END AS width, p_size % 3 = 0 OR p_partkey % 50 < 30 AS known FROM part""")
def sizes_hydrated(spark, sf_dir):
    """JON-16: sizes of source pages reach every copy of a page whose size was an estimate."""
    pages = table(spark, sf_dir, "part").selectExpr("p_brand AS doc", "p_partkey AS at", "p_partkey % 50 AS src", "p_retailprice AS width", "p_size % 3 = 0 AS known")
    sizes = table(spark, sf_dir, "part").where("p_partkey < 30").selectExpr("p_partkey AS src", "cast(p_partkey + 100 as double) AS new")
    rows = pages.join(F.broadcast(sizes), "src", "left")  # sizes of one batch of a document: 256 at most
    return rows.select("doc", "at", F.when(F.col("known"), F.col("width")).otherwise(F.coalesce("new", "width")).alias("width"), (F.col("known") | F.col("new").isNotNull()).alias("known"))


@query("open_requests", """WITH t AS (SELECT user_id AS owner, '/p' || (event_id % 40) AS path, min(event_id) AS tab FROM events WHERE event_id % 40 <= user_id GROUP BY ALL), n AS (SELECT user_id AS owner, count(*) FILTER (event_id % 40 <= user_id) AS n FROM events GROUP BY ALL),
    r AS (SELECT DISTINCT user_id AS owner, '/p' || k AS path, 5 + k AS pages FROM events, (SELECT unnest([0, 7, 30, 99]) AS k)), s AS (SELECT owner, path, 9 AS page FROM r WHERE path <> '/p0')
    SELECT r.owner, r.path, CASE WHEN tab IS NOT NULL THEN 'focus' WHEN n >= 30 THEN 'refuse' ELSE 'open' END AS action, tab, CASE WHEN tab IS NULL AND n < 30 THEN CASE WHEN s.page < r.pages THEN s.page ELSE 0 END END::INT AS page
    FROM r JOIN n USING (owner) LEFT JOIN t ON r.owner = t.owner AND r.path = t.path LEFT JOIN s ON r.owner = s.owner AND r.path = s.path""")
def open_requests(spark, sf_dir):
    """CMP-13: focus, refuse or open where it was left."""
    rows = table(spark, sf_dir, "events")
    tabs = rows.where("event_id % 40 <= user_id").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.concat(F.lit("/p"), F.col("event_id") % 40).alias("path"))
    asked = rows.select(F.col("user_id").alias("owner")).distinct().select("owner", F.explode(F.array(*[F.lit(k) for k in (0, 7, 30, 99)])).alias("k"))
    asked = asked.select("owner", F.concat(F.lit("/p"), "k").alias("path"), (5 + F.col("k")).alias("pages"))
    left = asked.where("path <> '/p0'").select("owner", "path", F.lit(9).alias("page"))
    return view.opened(asked, tabs, left)


@query("command_line_files", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ['/x/a.pdf', '/base/' || s_suppkey || '.pdf'] ELSE ['/x/a.pdf'] END AS files FROM supplier")
def command_line_files(spark, sf_dir):
    """CMP-14: flags, blanks and names of no file are skipped, relative names are below the caller's folder."""
    own = F.concat("s_suppkey", F.lit(".pdf"))
    arguments = F.array(F.lit("app"), F.lit(""), F.lit("--flag"), F.lit("/x/a.pdf"), own, F.lit("missing.pdf"))
    there = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("/x/a.pdf"), F.concat(F.lit("/base/"), own))).otherwise(F.array(F.lit("/x/a.pdf"), F.lit("app")))
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", view.file_arguments(arguments, F.lit("/base/"), there).alias("files"))


@query("selected_runs", """WITH r AS (SELECT o_custkey AS page, o_orderkey AS at, o_orderpriority AS text, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f, max(o_orderkey) OVER (PARTITION BY o_custkey) AS l FROM orders),
    c AS (SELECT page, "at", substr(text, CASE WHEN "at" = f THEN 3 ELSE 1 END, greatest(0, CASE WHEN "at" = l THEN 4 ELSE length(text) END - CASE WHEN "at" = f THEN 2 ELSE 0 END)) AS text FROM r) SELECT * FROM c WHERE text <> ''""")
def selected_runs(spark, sf_dir):
    """CMP-15: the first and the last run are cut at the selection's ends."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("text"))
    of = W.partitionBy("page")
    ends = runs.select("*", F.min("at").over(of).alias("first"), F.lit(2).alias("start"), F.max("at").over(of).alias("last"), F.lit(4).alias("end"))
    return view.selected(ends, "page")


@query("placed_images", """WITH p AS (SELECT p_partkey, (p_size * 10 + 100)::DOUBLE AS pw, 800.0::DOUBLE AS ph, (p_partkey % 700 + 10)::DOUBLE AS nw, (p_partkey % 300 + 5)::DOUBLE AS nh FROM part), s AS (SELECT *, least(pw * 0.4, nw * 0.75) AS w FROM p)
    SELECT p_partkey, round((pw - w) / 2, 6) AS x, round((ph - w * (nh / nw)) / 2, 6) AS y, round(w, 6) AS w, round(w * (nh / nw), 6) AS h FROM s""")
def placed_images(spark, sf_dir):
    """CMP-16."""
    k = F.col("p_partkey")
    rect = view.placed_image((F.col("p_size") * 10 + 100).cast("double"), F.lit(800.0), (k % 700 + 10).cast("double"), (k % 300 + 5).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", rect.alias("r")).select("p_partkey", *[F.round(f"r.{c}", 6).alias(c) for c in "xywh"])


@query("blank_pages", """WITH p AS (SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS at, p_retailprice AS w, p_size::DOUBLE AS h FROM part), d AS (SELECT doc, count(*) AS n FROM p GROUP BY doc UNION ALL SELECT 'empty', 0)
    SELECT d.doc, least(70 + 1, n)::INT AS at, coalesce(p.w, 612.0) AS width, coalesce(p.h, 792.0) AS height FROM d LEFT JOIN p ON p.doc = d.doc AND p.at = least(70, n - 1)""")
def blank_pages(spark, sf_dir):
    """CMP-16: a blank page after page 70, or the last, as large as that; in a document without pages of letter size."""
    order = W.partitionBy("doc").orderBy("p_partkey")
    pages = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "doc").select("doc", (F.row_number().over(order) - 1).alias("at"), F.struct(F.col("p_retailprice").alias("w"), F.col("p_size").cast("double").alias("h")).alias("size"))
    docs = pages.groupBy("doc").agg(F.count("*").alias("n"), F.max_by("size", F.when(F.col("at") <= 70, F.col("at"))).alias("size"))
    none = docs.limit(1).select(F.lit("empty").alias("doc"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(docs.schema["size"].dataType).alias("size"))
    return docs.unionByName(none).select("doc", F.least(F.lit(71), F.col("n")).cast("int").alias("at"), F.coalesce("size.w", F.lit(612.0)).alias("width"), F.coalesce("size.h", F.lit(792.0)).alias("height"))


@query("notes_rows", """WITH p AS (SELECT source AS doc, doc_id AS page_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at FROM documents), a AS (SELECT doc_id AS page_id, k AS at, CASE k WHEN 0 THEN text ELSE 'short ' || doc_id END AS quote FROM documents, (SELECT unnest([0, 1]) AS k))
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY p.at, a.at)::INT AS "row", (p.at + 1)::INT AS page, CASE WHEN p.at % 4 = 0 THEN p.at ELSE p.at % 4 END::INT AS src, CASE WHEN length(quote) > 220 THEN rtrim(substr(quote, 1, 220), ' ') || '…' ELSE quote END AS preview
    FROM p JOIN a USING (page_id)""")
def notes_rows(spark, sf_dir):
    """CMP-17: annotations in reading order, with previews."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    at = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    pages = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_id"), at.alias("at")).withColumn("src", F.when(F.col("at") % 4 != 0, F.col("at") % 4))
    quotes = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.array("text", F.concat(F.lit("short "), "doc_id"))).alias("at", "quote"))
    return view.notes(pages, quotes)


@query("library_lines", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN 'Scanning… ' || (s_suppkey % 4) || ' papers found so far.' WHEN s_suppkey % 7 < 5 THEN 'Indexing ' || (s_suppkey % 7) || ' of 5 — searching what is ready so far.'
    ELSE (s_suppkey % 4) || CASE WHEN s_suppkey % 4 = 1 THEN ' paper' ELSE ' papers' END || ' in the library.' END AS line, least(100, floor(s_suppkey % 4 * 100 / 3.0 + 0.5))::INT AS percent FROM supplier""")
def library_lines(spark, sf_dir):
    """CMP-18."""
    k = F.col("s_suppkey")
    line = view.library_line(k % 5, k % 3 == 0, k % 4, k % 7, F.lit(5))
    percent = F.least(F.lit(100), F.floor(k % 4 * 100 / 3.0 + 0.5).cast("int"))
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", line.alias("line"), percent.alias("percent"))


@query("tab_cycles", "SELECT c_custkey, CASE WHEN n < 2 THEN i ELSE (i + d + n) % n END::INT AS at FROM (SELECT c_custkey, (c_custkey % 6)::INT AS n, greatest(0, c_custkey % 5 % greatest(1, c_custkey % 6))::INT AS i, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS d FROM customer)")
def tab_cycles(spark, sf_dir):
    """CMP-20: forward and back round the ends; with fewer than two tabs nothing moves."""
    k = F.col("c_custkey")
    n, step = (k % 6).cast("int"), F.when(k % 2 == 0, 1).otherwise(-1)
    i = (k % 5 % F.greatest(F.lit(1), n)).cast("int")
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.when(n < 2, i).otherwise(F.pmod(i + step, n)).alias("at"))
