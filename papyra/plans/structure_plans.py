"""Structure: runs, lines, prose, captions, headings, figures, links, outlines and marked content."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import formats, headings
from papyra.operators import structure
from papyra.plans.library_plans import BOX_SQL, SHEETS, SHEETS_SQL, boxes
from papyra.registry import query, table


def typed(spark, sf_dir, text, size=9.0):
    """Characters of a text a part, 6 wide and `size` high, on lines 20 apart at each `|`; spaces have no box."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(text, "")).alias("at", "ch")).where("ch <> ''")
    line = F.lit(0)
    space = F.col("ch").isin(" ", "|")
    rows = rows.select("p_partkey", "at", F.when(F.col("ch") == "|", "\n").otherwise(F.col("ch")).alias("ch"), (F.col("at") * 6.0).alias("x"), (100.0 - line).alias("y"), F.when(space, 0.0).otherwise(6.0).alias("w"), F.when(space, 0.0).otherwise(size).alias("h"))
    return rows


@query("text_runs", "SELECT p_partkey, (sum(length(w) + 1) OVER (PARTITION BY p_partkey ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) - 1)::BIGINT AS start, w AS text, (6.0 * length(w))::DOUBLE AS w FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w, unnest(range(len(string_split(p_name || ' ' || p_type, ' ')))) AS i FROM part)")
def text_runs(spark, sf_dir):
    """WIN-02, SRC-09: where a gap is wider than 0.6 of the height a run ends, so here each word is one."""
    rows = structure.text_runs(typed(spark, sf_dir, F.concat_ws(" ", "p_name", "p_type")), ["p_partkey"])
    return rows.select("p_partkey", "start", "text", "w")


def lettered(spark, sf_dir):
    """Two lines a part: its name with a raised 2 and a lowered in, its type."""
    first, second = F.concat("p_name", F.lit("2in")), F.col("p_type")
    text = F.concat(first, F.lit("|"), second)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.char_length("p_name").alias("n"), F.posexplode(F.split(text, "")).alias("at", "ch")).where("ch <> ''")
    at, n = F.col("at"), F.col("n")
    up, down, below = at == n, (at > n) & (at < n + 3), at > n + 3
    script = up | down
    y = F.when(up, 103.6).when(down, 97.0).when(below, 80.0).otherwise(100.0)
    return rows.select("p_partkey", "at", F.when(F.col("ch") == "|", "\n").otherwise(F.col("ch")).alias("ch"), (at * 6.0).alias("x"), y.alias("y"), F.when(F.col("ch") == "|", 0.0).otherwise(6.0).alias("w"), F.when(F.col("ch") == "|", 0.0).when(script, 6.0).otherwise(9.0).alias("h"), F.when(script, 7.0).otherwise(10.0).alias("size"), F.lit(False).alias("math"))


@query("visual_lines", "SELECT p_partkey, p_name || '^2_{in}' AS text, 0.0::DOUBLE AS x, 100.0::DOUBLE AS y FROM part UNION ALL SELECT p_partkey, p_type, (6.0 * (length(p_name) + 4))::DOUBLE, 80.0 FROM part")
def visual_lines(spark, sf_dir):
    """WIN-03, GEO-15, AGG-04: baselines make lines, and smaller letters off them scripts."""
    return structure.visual_lines(lettered(spark, sf_dir), ["p_partkey"]).select("p_partkey", "text", "x", "y")


@query("copied_prose", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || lower(p_type) WHEN p_partkey % 3 = 1 THEN p_name || ' ' || p_type ELSE p_name || chr(10) || chr(10) || p_type END || ' end' AS text FROM part""")
def copied_prose(spark, sf_dir):
    """WIN-05, WIN-06, WIN-07: a word broken by a hyphen, a line that goes on, a paragraph."""
    k = F.col("p_partkey")
    run = lambda start, x, y, text: F.struct(F.lit(start).alias("start"), x.alias("x"), y.alias("y"), F.lit(50.0).alias("w"), F.lit(10.0).alias("h"), text.alias("text"))
    first = run(0, F.lit(10.0), F.lit(100.0), F.when(k % 3 == 0, F.concat("p_name", F.lit("-"))).otherwise(F.col("p_name")))
    second = run(1, F.lit(10.0), F.when(k % 3 == 2, 70.0).otherwise(88.0), F.when(k % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")))
    third = run(2, F.lit(63.0), F.when(k % 3 == 2, 70.0).otherwise(88.0), F.lit("end"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("page"), F.inline(F.array(first, second, third)))
    return structure.copied_prose(rows, "p_partkey")


@query("page_captions", """SELECT p_partkey, 0::BIGINT AS start, 'Figure ' || (p_partkey % 90 + 1) AS label, p_name || ' goes on' || CASE WHEN p_size % 2 = 0 THEN ' and ends' ELSE '' END AS title FROM part""")
def page_captions(spark, sf_dir):
    """WIN-08, TXT-28: a caption, the lines that continue it, one too far below."""
    k = F.col("p_partkey")
    line = lambda start, y, text: F.struct(F.lit(start).cast("long").alias("start"), F.lit(10.0).alias("x"), y.alias("y"), F.lit(10.0).alias("height"), text.alias("text"))
    lines = F.array(line(0, F.lit(100.0), F.concat(F.lit("Figure "), k % 90 + 1, F.lit(". "), "p_name")), line(1, F.lit(88.0), F.lit("goes on")), line(2, F.when(F.col("p_size") % 2 == 0, 76.0).otherwise(60.0), F.lit("and ends")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(lines)).withColumn("c", headings.caption(F.col("text")))
    rows = rows.select("p_partkey", "start", "x", "y", "height", "text", F.col("c.label").alias("label"), F.col("c.title").alias("rest"))
    return structure.captions(rows, ["p_partkey"]).select("p_partkey", "start", "label", "title")


@query("merged_structure")
def merged_structure(spark, sf_dir):
    """WIN-09, ORD-02: headings come once an environment follows them."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS id", "event_id DIV 40 AS page", "-event_id AS y", "event_type IN ('signup', 'purchase') AS heading", "CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS depth")
    return structure.merged_structure(rows, "doc")


@query("match_rects", """SELECT p_partkey, p_partkey AS match, 12.0::DOUBLE AS x, 100.0::DOUBLE AS y, 24.0::DOUBLE AS w, 9.0::DOUBLE AS h FROM part""")
def match_rects(spark, sf_dir):
    """WIN-10: four letters on one line are one rectangle."""
    chars = typed(spark, sf_dir, F.replace("p_name", F.lit(" "), F.lit("_")))
    matches = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("match"), F.lit(2).alias("start"), F.lit(4).alias("len"))
    return structure.match_rects(matches, chars, "p_partkey")


ANCHOR_SQL = f"""WITH b AS ({BOX_SQL}), g AS (SELECT l_orderkey AS page, l_linenumber AS pos, 30.0 - (y + h) AS gap FROM b WHERE x >= 10.0 - 4 AND 30.0 - (y + h) >= -6), n AS (SELECT *, min(gap) OVER (PARTITION BY page) AS near FROM g)"""


@query("anchor_starts", f"""{ANCHOR_SQL}, f AS (SELECT page, min(pos) AS start FROM n WHERE gap <= near + 5 GROUP BY page) SELECT p.page, f.start::INT AS start FROM (SELECT DISTINCT l_orderkey AS page FROM lineitem) p LEFT JOIN f ON p.page = f.page""")
def anchor_starts(spark, sf_dir):
    """GEO-13: the first character of the nearest line at or below an anchor, in its column."""
    chars = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("at"), *"xywh")
    anchors = chars.select("page").distinct().select("page", F.lit(0).alias("anchor"), F.lit(10.0).alias("ax"), F.lit(30.0).alias("ay"))
    return structure.anchor_starts(anchors, chars, "page").select("page", "start")


@query("anchor_texts", """SELECT conv_id, turn, CASE WHEN trim(substr(text, 21, 400), ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN substr(text, 21, 400) END AS text FROM conversations""")
def anchor_texts(spark, sf_dir):
    """GEO-14."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", structure.anchor_text(F.col("text"), F.lit(20)).alias("text"))


LINES_SQL = "SELECT l_orderkey AS page, l_linenumber AS start, (l_linenumber % 3 + 1) || '. ' || CASE WHEN l_partkey % 4 = 0 THEN '7' ELSE 'Title' END || ' ' || l_partkey AS text, l_quantity AS x, (l_partkey % 90)::DOUBLE AS y, l_partkey % 4 = 0 AS digit FROM lineitem"


def numbered_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS start", "concat(l_linenumber % 3 + 1, '. ', CASE WHEN l_partkey % 4 = 0 THEN '7' ELSE 'Title' END, ' ', l_partkey) AS text", "l_quantity AS x", "cast(l_partkey % 90 as double) AS y")
    anchors = rows.select("page").distinct().select("page", F.lit(1).alias("anchor"), F.lit(20.0).alias("ax"), F.lit(40.0).alias("ay"), F.lit("2").alias("counter"))
    return anchors, rows


@query("nearest_headings", f"""WITH l AS ({LINES_SQL}), c AS (SELECT page, text, y, row_number() OVER (PARTITION BY page ORDER BY abs(y - 40.0), start, text) AS r FROM l WHERE starts_with(text, '2') AND NOT digit AND abs(x - 20.0) <= 12)
    SELECT p.page, c.text, c.y AS line_y FROM (SELECT DISTINCT page FROM l) p LEFT JOIN c ON p.page = c.page AND r = 1""")
def nearest_headings(spark, sf_dir):
    """JON-07, GEO-18: of the lines that open with the counter in the anchor's column the nearest in height."""
    anchors, lines = numbered_lines(spark, sf_dir)
    lines = lines.dropDuplicates(["page", "start", "text", "x", "y"])
    rows = structure.nearest_line(anchors, lines, "page", structure.opens_near(F.col("text"), F.col("counter")))
    return rows.select("page", "text", "line_y")


@query("nearest_environments", """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS start, 'Theorem ' || (l_linenumber % 3 + 1) || '. text ' || l_partkey AS text, (l_partkey % 90)::DOUBLE AS y FROM lineitem),
    c AS (SELECT page, text, y, row_number() OVER (PARTITION BY page ORDER BY abs(y - 40.0), start, text) AS r FROM l WHERE starts_with(text, 'Theorem 2.')) SELECT p.page, c.text, c.y AS line_y FROM (SELECT DISTINCT page FROM l) p LEFT JOIN c ON p.page = c.page AND r = 1""")
def nearest_environments(spark, sf_dir):
    """JON-08, GEO-17: the nearest line whose heading has the counter."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS start", "concat('Theorem ', l_linenumber % 3 + 1, '. text ', l_partkey) AS text", "cast(l_partkey % 90 as double) AS y", "0D AS x")
    lines = lines.dropDuplicates().withColumn("number", headings.heading(F.col("text"))["number"])
    anchors = lines.select("page").distinct().select("page", F.lit(1).alias("anchor"), F.lit(40.0).alias("ay"), F.lit("2").alias("counter"))
    return structure.nearest_line(anchors, lines, "page", F.col("number") == F.col("counter")).select("page", "text", "line_y")


def crops(spark, sf_dir):
    runs = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").cast("string").alias("text"), "x", (F.col("y") * 20).alias("y"), "w", "h")
    pages = runs.select("page").distinct().select("page", F.lit(60.0).alias("page_w"), F.lit(700.0).alias("page_h"), (F.col("page") % 900).cast("double").alias("ay"), F.lit(5.0).alias("low"), F.lit(45.0).alias("high"))
    return structure.preview_crops(pages, runs, "page"), runs


@query("preview_crops")
def preview_crops(spark, sf_dir):
    """GEO-10: crops below anchors, as high as the text below goes on."""
    return crops(spark, sf_dir)[0]


@query("preview_specs")
def preview_specs(spark, sf_dir):
    """GEO-20: a crop and the text of the runs in it."""
    found, runs = crops(spark, sf_dir)
    return found.join(structure.preview_texts(found, runs, "page"), "page", "left").select("page", "x", "y", "w", "h", "text")


@query("figure_crops", f"""WITH r AS (SELECT l_orderkey AS page, x, y * 20 AS y, w, h FROM ({BOX_SQL})), f AS (SELECT DISTINCT page, least(700.0, (page % 800)::DOUBLE) AS cy FROM r),
    t AS (SELECT f.page, cy, greatest(cy, coalesce(max(r.y + r.h) FILTER (r.x + r.w > 5 AND r.x < 45 AND r.y BETWEEN cy - 1 AND cy + 1), cy)) AS top FROM f JOIN r ON f.page = r.page GROUP BY f.page, cy),
    e AS (SELECT t.page, top, coalesce(min(r.y) FILTER (r.x + r.w > 5 AND r.x < 45 AND r.y > top AND r.w >= 0.55 * 40), 700.0) AS ceiling FROM t JOIN r ON t.page = r.page GROUP BY t.page, top),
    h AS (SELECT *, greatest(60.0, least(525.0, ceiling - top)) AS tall FROM e), g AS (SELECT page, top, CASE WHEN top + tall > 700 THEN greatest(700 - top, 60.0) ELSE tall END AS tall FROM h), b AS (SELECT *, greatest(top - 4, 0) AS y FROM g)
    SELECT page, 1.0::DOUBLE AS x, y::DOUBLE AS y, 48.0::DOUBLE AS w, greatest(least(y + tall + 4, 700) - y, 1)::DOUBLE AS h FROM b""")
def figure_crops(spark, sf_dir):
    """GEO-11: what lies above a caption, up to prose."""
    _, runs = crops(spark, sf_dir)
    figures = runs.select("page").distinct().select("page", F.lit(1).alias("figure"), F.lit(60.0).alias("page_w"), F.lit(700.0).alias("page_h"), (F.col("page") % 800).cast("double").alias("cy"), F.lit(5.0).alias("low"), F.lit(45.0).alias("high"))
    return structure.figure_crops(figures, runs, "page").drop("figure")


@query("figure_panels", """SELECT p_partkey, 'Figure ' || (p_partkey % 90 + 1) AS label, 0::BIGINT AS tx, 172::BIGINT AS tw FROM part""")
def figure_panels(spark, sf_dir):
    """GEO-19: lines to captions to crops to tiles."""
    from papyra.functions import geometry as geo

    chars = typed(spark, sf_dir, F.concat(F.lit("Figure "), F.col("p_partkey") % 90 + 1, F.lit(". "), "p_name")).withColumn("size", F.lit(10.0)).withColumn("math", F.lit(False))
    lines = structure.visual_lines(chars, ["p_partkey"]).withColumn("c", headings.caption(F.col("text")))
    lines = lines.select("p_partkey", "start", "text", "x", "y", "height", F.col("c.label").alias("label"), F.col("c.title").alias("rest"))
    found = structure.captions(lines, ["p_partkey"]).select("p_partkey", "label", F.lit(1).alias("figure"), F.lit(100.0).alias("page_w"), F.lit(200.0).alias("page_h"), F.col("y").alias("cy"), F.lit(2.0).alias("low"), F.lit(82.0).alias("high"))
    runs = chars.where("w > 0").select("p_partkey", *"xywh")
    cropped = structure.figure_crops(found, runs, "p_partkey").join(found.select("p_partkey", "figure", "label"), ["p_partkey", "figure"])
    tile = geo.rect_to_tile(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(200.0), F.lit(2000.0))
    return cropped.select("p_partkey", "label", tile["x"].alias("tx"), tile["w"].alias("tw"))


@query("rect_texts", f"""WITH b AS ({BOX_SQL}) SELECT l_orderkey AS page, string_agg(l_linenumber::VARCHAR, '' ORDER BY l_linenumber) AS text FROM b WHERE x + w > 10 AND x < 30 AND y + h > 5 AND y < 25 GROUP BY l_orderkey""")
def rect_texts(spark, sf_dir):
    """JON-10: characters that a rectangle overlaps, in order."""
    chars = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("at"), F.col("l_linenumber").cast("string").alias("ch"), *"xywh")
    rects = chars.select("page").distinct().select("page", F.lit(0).alias("rect"), F.lit(10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"))
    return structure.rect_texts(rects, chars, "page").where("text IS NOT NULL").select("page", "text")


@query("links_sanitized", """WITH l AS (SELECT user_id % 5 AS page, event_id AS rect, CASE WHEN user_id % 5 < 3 THEN 'http://' || event_type || '.example.com/' || event_type END AS uri, event_id % 90 + 1 AS w, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS own, event_type FROM events)
    SELECT page, rect FROM l WHERE uri IS NULL OR (length(own) >= 5) OR page IN (SELECT page FROM l GROUP BY page, event_type HAVING false)
    UNION ALL SELECT page, rect FROM (SELECT *, row_number() OVER (PARTITION BY page, event_type ORDER BY own = '', w, length(own), rect) AS r FROM l WHERE uri IS NOT NULL AND length(event_type) < 5) WHERE r = 1""")
def links_sanitized(spark, sf_dir):
    """GEO-23, AGG-08: addresses with a rectangle in every line of a page keep those whose text belongs to them; else the narrowest."""
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("--")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("page"), F.col("event_id").alias("rect"), F.when(F.col("user_id") % 5 < 3, F.concat(F.lit("http://"), "event_type", F.lit(".example.com/"), "event_type")).alias("uri"),
        F.lit(0.0).alias("x"), (F.col("event_id") % 97 * 8).cast("double").alias("y"), (F.col("event_id") % 90 + 1).cast("double").alias("w"), F.lit(10.0).alias("h"), F.lit(800.0).alias("page_h"), text.alias("text"),
    )
    return structure.without_runaways(rows, "page").select("page", "rect")


@query("links_united", """SELECT event_id AS rect, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END::INT AS priority FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def links_united(spark, sf_dir):
    """SRC-18, SET-01: three sources by priority."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("page"), F.col("event_id").alias("rect"))
    of = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    return structure.links_of(of("click"), of("view"), of("purchase")).select("rect", "priority")


@query("owned_annotations", """SELECT l_orderkey AS page, list_sort(list(l_linenumber)) AS kept FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""")
def owned_annotations(spark, sf_dir):
    """SRC-16: annotations of kinds that can be edited, by page; a page without any is none."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    return rows.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("kept"))


@query("marked_content", """WITH c AS (SELECT l_orderkey AS page, l_suppkey % 3 AS mcid, l_linenumber AS pos FROM lineitem), g AS (SELECT page, mcid, list_sort(list(pos)) AS chars FROM c WHERE mcid > 0 GROUP BY ALL), e AS (SELECT DISTINCT page, 1 AS leaf, unnest([1, 2]) AS mcid FROM c)
    SELECT e.page, array_to_string(list_sort(flatten(list(chars))), '') AS text FROM e JOIN g ON e.page = g.page AND e.mcid = g.mcid GROUP BY e.page""")
def marked_content(spark, sf_dir):
    """SRC-19, AGG-09, JON-14: characters by marked-content id, and the text of an element with two of them."""
    chars = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_suppkey % 3 AS mcid", "l_linenumber AS at").where("mcid > 0")
    by_id = chars.groupBy("page", "mcid").agg(F.array_sort(F.collect_list("at")).alias("chars"))
    elements = chars.select("page").distinct().select("page", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("mcid"))
    held = elements.join(by_id, ["page", "mcid"]).groupBy("page").agg(F.array_sort(F.flatten(F.collect_list("chars"))).alias("chars"))
    return held.select("page", F.array_join(F.transform("chars", lambda c: c.cast("string")), "").alias("text"))


@query("math_spans")
def math_spans(spark, sf_dir):
    """GEO-16: spans begin up to six characters earlier, over what no other span has, but for white space."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "cast(turn % 9 + 3 as int) AS start").where("char_length(text) > start")
    claimed = F.sequence(F.lit(0), F.col("start") % 4)
    return rows.select("conv_id", "turn", formats.span_start(F.col("text"), F.col("start"), claimed).alias("start"))


@query("math_trees", r"""SELECT p_partkey, 'x^{' || p_size || 'a}\frac{' || p_size || '}{y_1}\sqrt[3]{z}' AS latex FROM part""")
def math_trees(spark, sf_dir):
    """TXT-30: a tree of tags and texts as LaTeX; phantoms print nothing, other tags their children."""
    leaf = lambda t: F.concat(F.lit('{"text":"'), t, F.lit('"}'))
    node = lambda tag, *c: F.concat(F.lit('{"tag":"' + tag + '","children":['), F.concat_ws(",", *c), F.lit("]}"))
    size = F.col("p_size").cast("string")
    tree = node("mrow", node("msup", leaf(F.lit("x")), leaf(F.concat(size, F.lit("a")))), node("mfrac", leaf(size), node("msub", leaf(F.lit("y")), leaf(F.lit("1")))), node("mphantom", leaf(F.lit("no"))), node("mroot", node("mstyle", leaf(F.lit("z"))), leaf(F.lit("3"))))
    return table(spark, sf_dir, "part").select("p_partkey", formats.latex(tree).alias("latex"))


OUTLINE_SQL = """SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey AS ord, r_name AS title, r_regionkey % 3 AS page, NULL::DOUBLE AS y FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '  ' ELSE n_name END, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey % 3 END, (n_nationkey % 4 * 100)::DOUBLE FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name, s_suppkey % 3, 50.0 FROM supplier UNION ALL SELECT 'x1', 'x2', 0, 'cycle', 0, 1.0 UNION ALL SELECT 'x2', 'x1', 0, 'cycle', 0, 1.0"""


@query("outline_entries", f"""WITH RECURSIVE o AS ({OUTLINE_SQL}), t AS (SELECT node, title, page, y, 0 AS depth, [ord::BIGINT] AS path FROM o WHERE parent IS NULL UNION ALL SELECT o.node, o.title, o.page, o.y, t.depth + 1, list_append(t.path, o.ord::BIGINT) FROM t JOIN o ON o.parent = t.node)
    SELECT row_number() OVER (ORDER BY page, coalesce(y, 'infinity'::DOUBLE) DESC, path)::INT AS place, node, least(depth, 1)::INT AS depth, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE trim(title) END AS label FROM t WHERE page IS NOT NULL""")
def outline_entries(spark, sf_dir):
    """SRC-15, ORD-04: a tree of bookmarks, walked depth first with a bound and without its cycles, as entries in document order."""
    from pyspark.sql import Window as W

    text = lambda c, n: F.concat(F.lit(n), c)
    none = lambda kind: F.lit(None).cast(kind)
    r = table(spark, sf_dir, "region").select(text("r_regionkey", "r").alias("node"), none("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("title"), (F.col("r_regionkey") % 3).cast("long").alias("page"), none("double").alias("y"))
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(text("n_nationkey", "n"), text("n_regionkey", "r"), k.cast("long"), F.when(k % 5 == 0, "  ").otherwise(F.col("n_name")), F.when(k % 7 != 0, k % 3).cast("long"), (k % 4 * 100).cast("double"))
    s = table(spark, sf_dir, "supplier").select(text("s_suppkey", "s"), text("s_nationkey", "n"), F.col("s_suppkey").cast("long"), "s_name", F.col("s_suppkey") % 3, F.lit(50.0))
    x = spark.createDataFrame([("x1", "x2", 0, "cycle", 0, 1.0), ("x2", "x1", 0, "cycle", 0, 1.0)], r.schema)
    entries = structure.outline_entries(r.union(n).union(s).union(x))
    order = W.orderBy("page", F.col("y").desc_nulls_first(), "path")
    return entries.select(F.row_number().over(order).alias("place"), "node", "depth", "label")


@query("named_anchors", """SELECT o_orderkey, 'section.' || (o_orderkey % 9) || '.' || (o_orderkey % 4) AS name, o_orderkey % 30 AS page FROM orders WHERE o_orderkey % 5 < 3 AND o_orderkey % 11 <> 0""")
def named_anchors(spark, sf_dir):
    """SRC-14, TXT-24: destinations with a counter, a page of the document and a height."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 < 3, F.concat(F.lit("section."), k % 9, F.lit("."), k % 4)).otherwise("Doc-Start")
    rows = table(spark, sf_dir, "orders").select(k, name.alias("name"), (k % 30).alias("page"), F.when(k % 11 != 0, k % 700).alias("y"))
    return rows.where(headings.destination_number(F.col("name")).isNotNull() & F.col("y").isNotNull() & F.col("page").between(0, 29)).select("o_orderkey", "name", "page")


@query("headings_by_column", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, event_id % 600 > 306, value DESC, event_id)::INT AS place FROM events""")
def headings_by_column(spark, sf_dir):
    """ORD-03: pages, then the left column before the right, then from the top."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy(F.col("event_id") % 5, F.col("event_id") % 600 > 306, F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(order).alias("place"))


@query("position_contexts", """WITH w AS (SELECT user_id AS doc, event_id AS id, event_type, event_id // 50 AS page, value AS y FROM events), e AS (SELECT * FROM w WHERE event_type = 'signup'), p AS (SELECT * FROM w WHERE event_type = 'view')
    SELECT p.doc, p.id, (SELECT e.id FROM e WHERE e.doc = p.doc AND (e.page < p.page OR (e.page = p.page AND e.y >= p.y)) ORDER BY e.page DESC, e.y, e.id DESC LIMIT 1) AS section FROM p""")
def position_contexts(spark, sf_dir):
    """JON-06: the last heading above a position, y pointing up."""
    from papyra.operators import lookup

    rows = table(spark, sf_dir, "events").where("event_type IN ('signup', 'view')").selectExpr("user_id AS doc", "event_id AS id", "struct(event_id DIV 50, -value) AS at", "CASE event_type WHEN 'signup' THEN 'section' ELSE 'point' END AS kind")
    return lookup.contexts(rows).select("doc", "id", "section")


@query("layout_positions", f"SELECT doc, src % 50 AS page, min(src) AS first FROM (SELECT {SHEETS_SQL}) GROUP BY ALL")
def layout_positions(spark, sf_dir):
    """JON-13: the first place in the layout that shows a source page."""
    rows = table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", "))
    return rows.groupBy("doc", (F.col("src") % 50).alias("page")).agg(F.min("src").alias("first"))


@query("layout_extents", f"SELECT doc, greatest(700.0, max(width) + 2 * 16)::DOUBLE AS total_w, (2 * 16 + sum(height) + 8 * (count(*) - 1))::DOUBLE AS total_h FROM (SELECT {SHEETS_SQL}) GROUP BY doc")
def layout_extents(spark, sf_dir):
    """AGG-13: the extents of all pages with padding and gaps."""
    rows = table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", "))
    return rows.groupBy("doc").agg(F.greatest(F.lit(700.0), F.max("width") + 32).alias("total_w"), (32.0 + F.sum("height") + 8 * (F.count("*") - 1)).alias("total_h"))
