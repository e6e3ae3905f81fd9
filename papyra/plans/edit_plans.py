"""The edit log: replay, plans, print copies, form filling, tabs and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import validate
from papyra.operators import edits, layout
from papyra.registry import placed, query, table

#: A log made of events: every user has a document of six pages, with two annotations of the file on page 1.
OPEN = '{"sizes":[[612,792],[612,792],[300,400],[595,842],[612,792],[200,900]]}'
ADOPT = '{"pages":[{"src":1,"annots":[{"kind":"highlight","rect":[1,2,3,4],"color":"#ffee00","opacity":0.5,"srcAnnotIndex":0},{"kind":"note","rect":[9,9,1,1],"color":"#00ff00","opacity":1,"text":"n","srcAnnotIndex":3}]},{"src":9,"annots":[]}]}'
OPS = """CASE event_id % 12
    WHEN 0 THEN concat('{"type":"rotate","pageId":"pg-', page, '","delta":', 90 * (event_id % 3 + 1), '}')
    WHEN 1 THEN concat('{"type":"reorder","pageId":"pg-', page, '","toIndex":', event_id % 5, '}')
    WHEN 2 THEN concat('{"type":"addBlank","index":', event_id % 4, ',"widthPt":612,"heightPt":792}')
    WHEN 3 THEN concat('{"type":"addAnnot","annot":{"id":"u', event_id, '","pageId":"pg-', page, '","kind":"', element_at(array('highlight', 'ink', 'textbox', 'image'), cast(event_id % 4 + 1 as int)), '","rect":[', event_id % 90, ',2,3,4],"color":"#000000","opacity":1,"text":"t', event_id, '","sourcePath":"/p/', event_id, '.png"}}')
    WHEN 4 THEN concat('{"type":"patchAnnot","pageId":"pg-2","id":"an-', event_id % 3 + 7, '","patch":{"color":"#', lpad(cast(event_id % 7 as string), 6, '0'), '"}}')
    WHEN 5 THEN concat('{"type":"deleteAnnot","pageId":"pg-2","id":"an-', event_id % 5 + 7, '"}')
    WHEN 6 THEN concat('{"type":"setForm","field":"f', event_id % 4, '","value":"', event_id, '"}')
    WHEN 7 THEN concat('{"type":"duplicate","pageId":"pg-', page, '"}')
    WHEN 8 THEN concat('{"type":"delete","pageId":"pg-', event_id % 40 + 3, '"}')
    ELSE '{}' END"""
ACTIONS = "CASE event_id % 12 WHEN 9 THEN 'undo' WHEN 10 THEN CASE WHEN event_id % 5 = 0 THEN 'save' ELSE 'undo' END WHEN 11 THEN 'redo' ELSE 'do' END"


def log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id", "event_id % 6 + 1 AS page")
    users = rows.select("doc").distinct()
    first = users.selectExpr("doc", "-2L AS seq", "'open' AS action", f"'{OPEN}' AS op")
    second = users.selectExpr("doc", "-1L AS seq", "'adopt' AS action", f"'{ADOPT}' AS op")
    return rows.selectExpr("doc", "event_id AS seq", f"{ACTIONS} AS action", f"{OPS} AS op").unionByName(first).unionByName(second)


@query("edit_states")
def edit_states(spark, sf_dir):
    """EDT-01, EDT-02, EDT-03: pages, history and whether something is unsaved, after each step."""
    return edits.edit_states(log(spark, sf_dir))


@query("edit_plans")
def edit_plans(spark, sf_dir):
    """EDT-04, EDT-06: what saving would write of each page after the whole log."""
    return edits.edit_plans(log(spark, sf_dir))


def plan(spark, sf_dir):
    """Plans made of parts: a document a brand."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS doc", "cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS int) AS at", "CASE WHEN p_size % 7 = 0 THEN null ELSE cast(p_partkey % 50 AS int) END AS src", "cast(p_size % 4 * 90 AS int) AS rotation", "p_size % 3 AS marks", "p_partkey AS k")
    some = lambda n, c: F.when(F.col("marks") >= n, F.array(c)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "doc", "at", "src", "rotation", some(1, F.lit("ink")).alias("annots"), some(2, F.concat(F.lit("t"), "k")).alias("texts"), some(2, F.lit("/i.png")).alias("images"),
        F.array((F.col("k") % 5).cast("int")).alias("drop"), F.array((F.col("k") % 5).cast("int"), F.lit(7)).alias("owned"),
    )


PLAN_SQL = """SELECT p_brand AS doc, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS "at", CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_partkey % 50)::INT END AS src, (p_size % 4 * 90)::INT AS rotation,
    p_size % 3 AS marks, p_partkey AS k FROM part"""


@query("plan_without_markup", f'SELECT doc, "at", src, 0::INT AS written, [(k % 5)::INT, 7::INT] AS dropped FROM ({PLAN_SQL})')
def plan_without_markup(spark, sf_dir):
    """EDT-07."""
    rows = edits.without_annotations(plan(spark, sf_dir))
    return rows.select("doc", "at", "src", (F.size("annots") + F.size("texts") + F.size("images")).alias("written"), F.col("drop").alias("dropped"))


@query("plan_limited_to_range", f"""WITH p AS ({PLAN_SQL}), n AS (SELECT doc, count(*) AS n FROM p GROUP BY doc)
    SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY "at") - 1)::INT AS "at", src FROM p JOIN n USING (doc) WHERE n < 12 OR "at" IN (1, 2, 3, 9, 10, 11)""")
def plan_limited_to_range(spark, sf_dir):
    """EDT-08, TXT-36: pages 10-12,2-4; a range beyond the document keeps all of it."""
    from pyspark.sql import Window as W

    rows = plan(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("doc")))
    return edits.limited(rows, validate.pages_in_range(F.lit("10-12,2-4"), F.col("n"))).select("doc", "at", "src")


@query("plan_imports", f"""WITH p AS ({PLAN_SQL}), b AS (SELECT *, CASE WHEN src = lag(src) OVER (PARTITION BY doc ORDER BY "at") + 1 THEN 0 ELSE 1 END AS b FROM p),
    g AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS batch FROM b)
    SELECT doc, batch::INT AS batch, CASE WHEN min(src) IS NULL THEN 'blank' ELSE 'import' END AS kind, min(src) AS first, count(*) AS pages, count(*) AS edits FROM g GROUP BY doc, batch""")
def plan_imports(spark, sf_dir):
    """SNK-12: runs of successive source pages are one import; here every page drops something, so all are edits."""
    return edits.imports(plan(spark, sf_dir))


@query("annotations_changed", """WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS id, any_value(l_returnflag) AS kind, any_value(l_quantity) AS x, any_value(l_tax) AS opacity FROM lineitem GROUP BY ALL)
    SELECT doc, id, id % 3 = 1 OR (id % 3 = 2 AND x IS DISTINCT FROM 10.0) AS changed FROM a""")
def annotations_changed(spark, sf_dir):
    """EDT-05: an annotation is changed if its fingerprint is; a width set to what it was is no change.
    Of rows with the same key each value is the first in file order that is not null."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    rows = placed(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id")).agg(first("l_returnflag").alias("kind"), first("l_quantity").alias("x"), first("l_tax").alias("opacity"))

    def annotation(width, text):
        none = F.lit(None).cast("string")
        return F.struct(F.col("kind").alias("kind"), F.array(width, F.lit(1.0)).alias("rect"), none.alias("color"), F.col("opacity").alias("opacity"), none.alias("strokeWidth"), none.alias("quads"), none.alias("strokes"), text.alias("text"), F.lit(1).alias("extra"), none.alias("fontSizePt"))

    third = F.col("id") % 3
    before, after = annotation(F.col("x"), F.lit("t")), annotation(F.when(third == 2, F.lit(10.0)).otherwise(F.col("x")), F.when(third == 1, F.lit(None)).otherwise(F.lit("t")))
    return rows.select("doc", "id", (edits.annotation_key(before) != edits.annotation_key(after)).alias("changed"))


@query("form_filled", """WITH w AS (SELECT o_custkey AS doc, o_orderkey AS id, 'f' || (o_orderkey % 9) AS name, CASE o_orderstatus WHEN 'O' THEN 'text' WHEN 'F' THEN 'checkbox' ELSE 'combo' END AS kind, o_orderpriority AS value FROM orders),
    p AS (SELECT c_custkey AS doc, 'f' || (unnest([0, 3, 3, 5]) + 0) AS name, unnest([0, 1, 2, 3]) AS "at", 'v' || c_nationkey || '-' || unnest([0, 1, 2, 3]) AS value FROM customer),
    f AS (SELECT doc, name, min_by(value, "at") AS new FROM p GROUP BY ALL)
    SELECT w.doc, id, CASE WHEN kind = 'text' THEN coalesce(f.new, w.value) ELSE w.value END AS value FROM w LEFT JOIN f ON w.doc = f.doc AND w.name = f.name""")
def form_filled(spark, sf_dir):
    """JON-15, SRC-17: the first value of a name fills its text fields; other kinds stay."""
    kind = F.when(F.col("o_orderstatus") == "O", "text").when(F.col("o_orderstatus") == "F", "checkbox").otherwise("combo")
    widgets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_orderkey") % 9).alias("name"), kind.alias("kind"), F.col("o_orderpriority").alias("value"))
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), "c_nationkey", F.posexplode(F.array(*[F.lit(x) for x in (0, 3, 3, 5)])).alias("at", "n"))
    given = given.select("doc", "at", F.concat(F.lit("f"), "n").alias("name"), F.concat(F.lit("v"), "c_nationkey", F.lit("-"), "at").alias("value"))
    return edits.filled_form(widgets, given).select("doc", "id", F.coalesce("new", "value").alias("value"))


@query("form_field_kinds", """SELECT l_orderkey AS doc, l_linenumber AS page, 'w' || l_partkey AS name, coalesce(['text', 'checkbox', 'radio', 'combo', 'list', 'button', 'signature'][l_partkey % 9 + 1], 'unknown') AS kind, l_suppkey % 2 = 1 AS read_only, count(*) AS n FROM lineitem GROUP BY ALL""")
def form_field_kinds(spark, sf_dir):
    """SRC-17: type codes to kinds, and the read-only bit of the flags."""
    kinds = F.array(*[F.lit(x) for x in ("text", "checkbox", "radio", "combo", "list", "button", "signature")])
    kind = F.coalesce(F.get(kinds, (F.col("l_partkey") % 9).cast("int")), F.lit("unknown"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.concat(F.lit("w"), "l_partkey").alias("name"), kind.alias("kind"), (F.col("l_suppkey").bitwiseAND(1) == 1).alias("read_only"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("tabs_reordered", """WITH t AS (SELECT c_custkey, ['a', 'b', 'c', 'd', 'e'] AS tabs, (c_custkey % 7 - 1)::INT AS s, (c_custkey % 5)::INT AS t FROM customer), l AS (SELECT *, list_filter(tabs, lambda x, i: i <> s + 1) AS rest FROM t)
    SELECT c_custkey, CASE WHEN s BETWEEN 0 AND 4 THEN rest[:t] || [tabs[s + 1]] || rest[t + 1:] ELSE tabs END AS tabs FROM l""")
def tabs_reordered(spark, sf_dir):
    """EDT-11: one tab moves; a place that isn't there moves none."""
    tabs = F.array(*[F.lit(x) for x in "abcde"])
    rows = table(spark, sf_dir, "customer", "c_custkey")
    return rows.select("c_custkey", edits.reordered(tabs, (F.col("c_custkey") % 7 - 1).cast("int"), (F.col("c_custkey") % 5).cast("int")).alias("tabs"))


@query("sessions_restored", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['/a' || c_custkey, '/b'] WHEN 1 THEN ['/c'] ELSE []::VARCHAR[] END AS tabs, CASE WHEN c_custkey % 4 = 0 THEN '/b' END AS active FROM customer""")
def sessions_restored(spark, sf_dir):
    """EDT-11: stored sessions, one whole, one with entries that are no tabs, one without tabs and one torn."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"version":1,"tabs":[{"path":"/a'), k, F.lit('"},{"path":"/b"}],"activePath":"/b"}')))
    raw = raw.when(k % 4 == 1, '{"tabs":[{"path":7},null,{"path":"/c"},{"name":"x"}],"activePath":5}').when(k % 4 == 2, '{"tabs":"none","activePath":5}').otherwise('{"tabs":[{"pa')
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", layout.restored_session(raw).alias("s")).select("c_custkey", "s.tabs", "s.active")


@query("print_jobs", """WITH j AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Laser_' || s_suppkey WHEN 1 THEN '-d' WHEN 2 THEN 'ok' ELSE 'two words' END AS printer, s_suppkey % 120 AS copies, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '2-5,9' WHEN 2 THEN '3' || chr(10) ELSE '7' END AS pages FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND copies BETWEEN 1 AND 99 AND s_suppkey % 5 <> 2 THEN ['-d', printer, '-n', copies::VARCHAR] || CASE WHEN pages IS NULL THEN [] ELSE ['-o', 'page-ranges=' || pages] END || ['-o', 'sides=two-sided', '/tmp/job.pdf'] END AS arguments FROM j""")
def print_jobs(spark, sf_dir):
    """EDT-12: argument lists; a printer that reads as a flag, a name with a space, no copies and a range with a line end are refused."""
    k = F.col("s_suppkey")
    printer = F.when(k % 4 == 0, F.concat(F.lit("Laser_"), k)).when(k % 4 == 1, "-d").when(k % 4 == 2, "ok").otherwise("two words")
    pages = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "2-5,9").when(k % 5 == 2, "3\n").otherwise("7")
    options = F.array(F.struct(F.lit("sides").alias("key"), F.lit("two-sided").alias("value")))
    return table(spark, sf_dir, "supplier", "s_suppkey").select(k, validate.print_arguments(printer, k % 120, pages, options, F.lit("/tmp/job.pdf")).alias("arguments"))
