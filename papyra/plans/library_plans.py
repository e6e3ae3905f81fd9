"""Catalog, lookups, layout, budgets and jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import geometry as geo
from papyra.operators import layout, lookup
from papyra.plans.text_plans import PAGES_SQL, pages
from papyra.registry import query, table
from papyra.sources import catalog
from papyra.streaming import queries as streams

FILE = ["concat('/lib/r', o_orderkey % 7, '/', o_orderkey, '.pdf') AS path", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate) AS mtime_ms", "cast(o_orderkey * 3 % 10007 as long) AS size"]
FILE_SQL = "'/lib/r' || (o_orderkey % 7) || '/' || o_orderkey || '.pdf' AS path, epoch_ms(o_orderdate) AS mtime_ms, (o_orderkey * 3 % 10007)::BIGINT AS size"


def files(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *FILE)


@query("library_containment", f"SELECT path FROM (SELECT {FILE_SQL} FROM orders) WHERE starts_with(path, '/lib/r1/') OR starts_with(path, '/lib/r4/')")
def library_containment(spark, sf_dir):
    """SRC-03: a root that is only a prefix of a folder's name holds nothing."""
    return files(spark, sf_dir).where(catalog.under(F.col("path"), ["/lib/r1", "/lib/r4/", "/lib/r"])).select("path")


@query("scan_schedule", f"SELECT DISTINCT path FROM (SELECT {FILE_SQL} FROM orders)")
def scan_schedule(spark, sf_dir):
    """SRC-05, SET-06: nested roots give a file once."""
    every = files(spark, sf_dir)
    return catalog.schedule([every, every.where(catalog.under(F.col("path"), ["/lib/r3"]))])


@query("incremental_changes", f"""SELECT path, CASE WHEN k % 13 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' WHEN k % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change
    FROM (SELECT o_orderkey AS k, {FILE_SQL} FROM orders) WHERE NOT (k % 11 = 0 AND k % 13 = 0)""")
def incremental_changes(spark, sf_dir):
    """SRC-04, SRC-06."""
    every = files(spark, sf_dir)
    now = every.where("o_orderkey % 11 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return catalog.changes(now, every.where("o_orderkey % 13 <> 0"))


@query("catalog_upsert", f"SELECT path, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END::INT AS epoch, size + CASE WHEN k % 5 = 0 THEN 9 ELSE 0 END AS size FROM (SELECT o_orderkey AS k, {FILE_SQL} FROM orders)")
def catalog_upsert(spark, sf_dir):
    """SRC-07."""
    every = files(spark, sf_dir)
    old = every.select("path", F.lit(1).alias("epoch"), "size")
    new = every.where("o_orderkey % 5 = 0").select("path", F.lit(2).alias("epoch"), (F.col("size") + 9).alias("size"))
    return catalog.upsert(old, new)


@query("catalog_json", "SELECT c_custkey, '/lib/' || c_custkey || '.pdf' AS path, c_custkey * 10 AS mtime_ms, c_custkey AS size FROM customer WHERE c_custkey % 4 < 2")
def catalog_json(spark, sf_dir):
    """SRC-13: an envelope of version 1, a bare array, a newer version and a broken file."""
    k = F.col("c_custkey")
    entry = F.concat(F.lit('{"path":"/lib/'), k, F.lit('.pdf","mtime_ms":'), k * 10, F.lit(',"size":'), k, F.lit("}"))
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"version":1,"entries":['), entry, F.lit("]}"))).when(k % 4 == 1, F.concat(F.lit(" ["), entry, F.lit("]")))
    raw = raw.when(k % 4 == 2, F.concat(F.lit('{"version":3,"entries":['), entry, F.lit("]}"))).otherwise('{"version":2,"entr')
    rows = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(catalog.catalog_entries(raw)).alias("e"))
    return rows.select("c_custkey", "e.path", "e.mtime_ms", "e.size")


SHEETS = "p_brand AS doc, p_partkey AS src, cast(p_size * 10 + 100 as double) AS width, cast(p_partkey % 97 + 50 as double) AS height"
SHEETS_SQL = "p_brand AS doc, p_partkey AS src, (p_size * 10 + 100)::DOUBLE AS width, (p_partkey % 97 + 50)::DOUBLE AS height FROM part"


@query("page_size_estimates", f"""WITH p AS (SELECT * FROM (SELECT {SHEETS_SQL}) WHERE src < 64), d AS (SELECT DISTINCT p_brand AS doc FROM part)
    SELECT d.doc, coalesce(list_sort(list(width) FILTER (width IS NOT NULL))[count(width) // 2 + 1], 612.0) AS width, coalesce(list_sort(list(height) FILTER (height IS NOT NULL))[count(height) // 2 + 1], 792.0) AS height
    FROM d LEFT JOIN p ON d.doc = p.doc GROUP BY d.doc""")
def page_size_estimates(spark, sf_dir):
    """SRC-20, AGG-05."""
    return catalog.page_size_estimates(table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", ")))


@query("citation_resolution", """WITH l AS (SELECT '/lib/' || lpad(s_suppkey::VARCHAR, 6, '0') AS path, s_name AS title, '10.1000/' || (s_suppkey % 40) AS doi FROM supplier),
    f AS (SELECT doi, min(path) AS path, min_by(title, path) AS title FROM l GROUP BY doi)
    SELECT c_custkey, f.path, coalesce(f.title, c_name) AS title FROM customer LEFT JOIN f ON doi = '10.1000/' || (c_custkey % 60)""")
def citation_resolution(spark, sf_dir):
    """JON-01, JON-02."""
    library = table(spark, sf_dir, "supplier").selectExpr("concat('/lib/', lpad(cast(s_suppkey as string), 6, '0')) AS path", "s_name AS title", "concat('10.1000/', s_suppkey % 40) AS doi", "cast(null as string) AS arxiv")
    cited = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "'doi' AS scheme", "concat('10.1000/', c_custkey % 60) AS value")
    return lookup.resolve(cited, library).select("c_custkey", "path", F.coalesce("title", "c_name").alias("title"))


@query("structure_context", """WITH w AS (SELECT user_id AS doc, event_id AS id, event_type,
      max(CASE WHEN event_type = 'signup' THEN event_id END) OVER p AS s, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER p AS b, max(CASE WHEN event_type = 'error' THEN event_id END) OVER p AS e
      FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
    SELECT doc, id, s AS section, CASE WHEN b > coalesce(s, -1) THEN b END AS subsection, CASE WHEN e > greatest(coalesce(s, -1), coalesce(b, -1)) THEN e END AS environment FROM w WHERE event_type IN ('view', 'click')""")
def structure_context(spark, sf_dir):
    """JON-05."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "section", "purchase", "subsection", "error", "environment")])
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("at"), F.col("event_id").alias("id"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("point")).alias("kind"))
    return lookup.contexts(rows)


BOX = "l_orderkey, l_linenumber, l_quantity AS x, cast(l_partkey % 30 as double) AS y, cast(l_linenumber * 5 as double) AS w, 12.0D AS h"
BOX_SQL = "SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_partkey % 30)::DOUBLE AS y, (l_linenumber * 5)::DOUBLE AS w, 12.0::DOUBLE AS h FROM lineitem"


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*BOX.split(", "))


@query("runs_under_quads", f"""WITH b AS ({BOX_SQL}) SELECT r.l_orderkey, r.l_linenumber FROM b r WHERE r.l_linenumber % 2 = 1 AND EXISTS (SELECT 1 FROM b q WHERE q.l_orderkey = r.l_orderkey AND q.l_linenumber % 2 = 0
    AND greatest(0, least(r.x + r.w, q.x + q.w) - greatest(r.x, q.x)) * greatest(0, least(r.y + r.h, q.y + q.h) - greatest(r.y, q.y)) >= 0.5 * r.w * r.h)""")
def runs_under_quads(spark, sf_dir):
    """JON-09."""
    b = boxes(spark, sf_dir)
    return lookup.covered(b.where("l_linenumber % 2 = 1"), b.where("l_linenumber % 2 = 0"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("links_deduplicated")
def links_deduplicated(spark, sf_dir):
    """JON-17: which links stay depends on those kept before them."""
    return lookup.without_duplicates(boxes(spark, sf_dir), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


STACK_SQL = f"SELECT doc, src, height, 16 + coalesce(sum(height + 8) OVER (PARTITION BY doc ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM (SELECT {SHEETS_SQL})"


def stacked(spark, sf_dir):
    return layout.stack(table(spark, sf_dir, "part").selectExpr(*SHEETS.split(", ")), 16, 8).select("doc", "src", "height", "top")


@query("page_layout", STACK_SQL)
def page_layout(spark, sf_dir):
    """WIN-01."""
    return stacked(spark, sf_dir)


@query("visible_pages", f"SELECT doc, min(src) AS first, max(src) AS last FROM ({STACK_SQL}) WHERE top <= 500 + 900 + 100 AND top + height >= 500 - 100 GROUP BY doc")
def visible_pages(spark, sf_dir):
    """JON-11."""
    view = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc")).distinct().select("doc", F.lit(500.0).alias("scroll"), F.lit(900.0).alias("view_h"))
    return lookup.visible_pages(stacked(spark, sf_dir), view, 100.0)


@query("page_at_position", f"SELECT doc, coalesce(min(src) FILTER (top + height >= 700), max(src)) AS page FROM ({STACK_SQL}) GROUP BY doc")
def page_at_position(spark, sf_dir):
    """JON-12."""
    return lookup.page_at(stacked(spark, sf_dir), F.lit(700.0))


@query("library_status", "SELECT count(*) AS entries, count(*) FILTER (doc_id % 3 <> 0) AS text_indexed, min(doc_id) FILTER (doc_id % 3 = 0) AS next_unindexed FROM documents")
def library_status(spark, sf_dir):
    """AGG-02, ORD-06."""
    done = F.col("doc_id") % 3 != 0
    return table(spark, sf_dir, "documents", "doc_id").agg(F.count("*").alias("entries"), F.count_if(done).alias("text_indexed"), F.min(F.when(~done, F.col("doc_id"))).alias("next_unindexed"))


@query("median_heights", "SELECT l_orderkey, coalesce(quantile_cont(greatest(l_quantity, 1), 0.5), 11) AS height FROM lineitem GROUP BY l_orderkey")
def median_heights(spark, sf_dir):
    """AGG-03."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
    return rows.groupBy("l_orderkey").agg(F.coalesce(F.percentile(F.greatest("l_quantity", F.lit(1.0)), 0.5), F.lit(11.0)).alias("height"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """AGG-06: p (n - 1), interpolated."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count("*").alias("n"))


@query("sampled_pages", """SELECT p_partkey, unnest(CASE WHEN p_size <= 12 THEN list_transform(range(p_size), lambda i: i::INT) ELSE list_transform(range(12), lambda i: floor(i * (p_size - 1) / 11.0::DOUBLE + 0.5)::INT) END) AS i FROM part""")
def sampled_pages(spark, sf_dir):
    """AGG-07: indices of the pages that a measurement takes."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.explode(layout.sample_indices(F.col("p_size"), 12)).alias("i"))


@query("cache_ratios", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0) AS ratio, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def cache_ratios(spark, sf_dir):
    """AGG-10, and extremes of a value."""
    looked = F.count_if(F.col("event_type").isin("view", "click"))
    ratio = F.count_if(F.col("event_type") == "view").cast("double") / F.nullif(looked, F.lit(0))
    return table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id").agg(ratio.alias("ratio"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("column_bounds", f"""WITH b AS (SELECT l_orderkey AS page, x AS low, x + w AS high FROM ({BOX_SQL})), r AS (SELECT *, max(high) OVER (PARTITION BY page ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR low - reach >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT page, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY page, island""")
def column_bounds(spark, sf_dir):
    """WIN-04: 2 % of a page 50 wide."""
    rows = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("x").alias("low"), (F.col("x") + F.col("w")).alias("high"))
    return layout.columns(rows, F.lit(1.0))


@query("tile_grid", "SELECT p_partkey, x::INT AS x, y::INT AS y, least(256, width - x)::INT AS w, least(256, height - y)::INT AS h FROM (SELECT *, unnest(range(0, width, 256)) AS x FROM (SELECT *, unnest(range(0, height, 256)) AS y FROM (SELECT p_partkey, p_size * 20 AS width, p_size * 15 + 7 AS height FROM part)))")
def tile_grid(spark, sf_dir):
    """WIN-11, GEO-12."""
    return layout.tiles(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 20 AS width", "p_size * 15 + 7 AS height"), "p_partkey", 256)


@query("nested_headings", "SELECT user_id AS doc, event_id AS id, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END::INT AS depth, CASE WHEN event_type <> 'signup' THEN max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent FROM events")
def nested_headings(spark, sf_dir):
    """WIN-12."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS id", "CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS depth")
    return layout.nested(rows)


@query("palette_sections", "SELECT p_brand, p_partkey, rank::INT AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 6")
def palette_sections(spark, sf_dir):
    """WIN-13, ORD-01."""
    return layout.first_of_each(table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), "p_partkey"], 6).select("p_brand", "p_partkey", "rank")


@query("recent_documents", """SELECT user_id, path, opened, rank::INT AS rank FROM (SELECT user_id, path, opened, row_number() OVER (PARTITION BY user_id ORDER BY opened DESC, path) AS rank
    FROM (SELECT user_id, '/lib/' || (event_id % 37) || '.pdf' AS path, max(event_id) AS opened FROM events GROUP BY ALL)) WHERE rank <= 20""")
def recent_documents(spark, sf_dir):
    """WIN-14."""
    return layout.recent(table(spark, sf_dir, "events").selectExpr("user_id", "concat('/lib/', event_id % 37, '.pdf') AS path", "event_id AS opened"), "user_id", 20)


@query("budget_prefix", f"SELECT doc_id AS doc, src::INT AS src FROM (SELECT doc_id, src, sum(64 + strlen(raw)) OVER (PARTITION BY doc_id ORDER BY src ROWS UNBOUNDED PRECEDING) AS spent FROM ({PAGES_SQL})) WHERE spent <= 2000")
def budget_prefix(spark, sf_dir):
    """STR-09: the pages that a budget covers from the first on."""
    rows = pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), "src", (64 + F.octet_length("raw")).cast("long").alias("cost"))
    return layout.within_budget(rows, 2000).select("doc", "src")


@query("stale_jobs", """WITH j AS (SELECT user_id AS doc, event_id AS seq, (event_id % 20)::BIGINT AS stamp, event_type = 'error' AS bump FROM events), g AS (SELECT doc, count(*) FILTER (bump) AS n FROM j GROUP BY doc)
    SELECT j.doc, seq, stamp < n AS stale FROM j JOIN g ON j.doc = g.doc""")
def stale_jobs(spark, sf_dir):
    """STR-04."""
    return layout.stale_jobs(table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS seq", "event_id % 20 AS stamp", "event_type = 'error' AS bump")).select("doc", "seq", "stale")


@query("job_order", "SELECT user_id AS doc, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 9, event_id)::INT AS turn FROM events")
def job_order(spark, sf_dir):
    """Jobs of each document by level, first come first served within one; queue_order has the queue over all."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS seq", "event_id % 9 AS level")
    return layout.first_of_each(rows, "doc", ["level", "seq"], 2**31 - 1).select("doc", "seq", F.col("rank").alias("turn"))


@query("latest_results", "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_results(spark, sf_dir):
    """STR-05."""
    return layout.latest_result(table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS seq", "event_type", "value"), "user_id")


@query("debounced_queries", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 7201 SECOND THEN 0 ELSE 1 END AS starts FROM events),
    b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT user_id, max(ts) AS ts, max_by(event_id, ts) AS event_id, count(*) AS n FROM b GROUP BY user_id, burst""")
def debounced_queries(spark, sf_dir):
    """STR-06, on events hours apart."""
    return streams.debounced(table(spark, sf_dir, "events", "user_id", "ts", "event_id"), "user_id", "7201 seconds")


@query("indexing_progress", f"SELECT doc_id AS doc, count(*) AS pages, sum(length(raw))::BIGINT AS chars FROM ({PAGES_SQL}) GROUP BY doc_id")
def indexing_progress(spark, sf_dir):
    """STR-01: pages and characters so far."""
    return streams.indexing_progress(pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), "raw"))


@query("page_rotations", "SELECT user_id, event_id % 10 AS page, (sum((event_id % 4) * 90) % 360)::BIGINT AS rotation FROM events GROUP BY ALL")
def page_rotations(spark, sf_dir):
    """EDT-09: turns of a page add up."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 10 AS page", "event_id % 4 * 90 AS turn")
    return rows.groupBy("user_id", "page").agg(F.pmod(F.sum("turn"), F.lit(360)).alias("rotation"))


@query("annotations_dropped", """SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber), 'DESC') AS dropped FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber AND k.l_partkey % 3 <> 0) GROUP BY l_orderkey""")
def annotations_dropped(spark, sf_dir):
    """JON-04, SET-04, EDT-10: source indices that no edited annotation kept, the highest first."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    gone = rows.join(rows.where("l_partkey % 3 <> 0"), ["l_orderkey", "l_linenumber"], "left_anti")
    return gone.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber"), asc=False).alias("dropped"))


@query("posting_sets", """WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_linenumber) FILTER (l_partkey % 2 = 0)) AS a, list_sort(list(DISTINCT l_linenumber) FILTER (l_quantity > 20)) AS b FROM lineitem GROUP BY 1), c AS (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM l)
    SELECT k AS l_orderkey, list_sort(list_intersect(a, b)) AS both, list_sort(list_distinct(a || b)) AS either, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest FROM c""")
def posting_sets(spark, sf_dir):
    """SET-02, SET-03, SET-05: two lists of an order's lines; at most seven an order."""
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_linenumber"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(some(F.col("l_partkey") % 2 == 0).alias("a"), some(F.col("l_quantity") > 20).alias("b"))
    return rows.select("l_orderkey", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_union("a", "b")).alias("either"), F.array_sort(F.array_except("a", "b")).alias("rest"))


_ladder = ", ".join(f"{z}::DOUBLE" for z in geo.ZOOMS)
_scales = ", ".join(f"{z}::DOUBLE" for z in geo.SCALES)


@query("zoom_steps", f"""WITH z AS (SELECT p_partkey, p_size / 8.0::DOUBLE AS z FROM part) SELECT p_partkey, coalesce(list_filter([{_ladder}], lambda s: s > z + 1e-6)[1], 6.0::DOUBLE) AS up,
    coalesce(list_filter([{_ladder}], lambda s: s < z - 1e-6)[-1], 0.25::DOUBLE) AS down, coalesce(list_filter([{_scales}], lambda s: s >= z - 1e-9)[1], 12.0::DOUBLE) AS bucket FROM z""")
def zoom_steps(spark, sf_dir):
    """ORD-08, ORD-09."""
    z = F.col("p_size") / 8.0
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", geo.zoom_step(z, True).alias("up"), geo.zoom_step(z, False).alias("down"), geo.scale_bucket(z).alias("bucket"))


@query("geometry_maps", """WITH p AS (SELECT p_partkey, (p_size * 10 + 100)::DOUBLE AS w, (p_partkey % 97 + 50)::DOUBLE AS h, (p_partkey % 4) * 90 AS r, (p_partkey % 50)::DOUBLE AS x, (p_partkey % 40)::DOUBLE AS y FROM part)
    SELECT p_partkey, CASE r WHEN 90 THEN y WHEN 180 THEN w - x WHEN 270 THEN h - y ELSE x END AS dx, CASE r WHEN 90 THEN w - x WHEN 180 THEN h - y WHEN 270 THEN x ELSE y END AS dy, x AS back_x, y AS back_y,
      2 * CASE r WHEN 90 THEN y WHEN 180 THEN w - x WHEN 270 THEN h - y ELSE x END AS cx, 2 * CASE r WHEN 90 THEN x WHEN 180 THEN y WHEN 270 THEN w - x ELSE h - y END AS cy,
      2 * CASE WHEN r IN (90, 270) THEN h ELSE w END AS css_w, 2 * CASE WHEN r IN (90, 270) THEN w ELSE h END AS css_h FROM p""")
def geometry_maps(spark, sf_dir):
    """GEO-01 to GEO-06: page space to the shown page, back, and to screen pixels."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 10 + 100 as double) AS w", "cast(p_partkey % 97 + 50 as double) AS h", "cast(p_partkey % 4 * 90 as int) AS r", "cast(p_partkey % 50 as double) AS x", "cast(p_partkey % 40 as double) AS y")
    x, y, w, h, r = (F.col(c) for c in "xywhr")
    dx, dy = geo.user_to_display(x, y, w, h, r)
    back, css, size = geo.display_to_user(dx, dy, w, h, r), geo.page_to_css(x, y, w, h, r, F.lit(2.0)), geo.css_size(w, h, r, F.lit(2.0))
    names = ["dx", "dy", "back_x", "back_y", "cx", "cy", "css_w", "css_h"]
    return rows.select("p_partkey", *[c.alias(n) for c, n in zip((dx, dy, *back, *css, *size), names, strict=True)])
