"""State between events: caches, shared stores, hovering, scheduling, histories and the job queue, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import stateful
from papyra.registry import query, table

CACHE = """CASE event_id % 10 WHEN 0 THEN 'stale' WHEN 1 THEN 'drop' WHEN 2 THEN 'budget' WHEN 3 THEN 'put' WHEN 4 THEN 'put' WHEN 5 THEN 'put' ELSE 'get' END"""


def cache_log(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id AS seq", f"{CACHE} AS action", "concat('d', event_id % 3, '/', CASE WHEN event_id % 10 < 2 THEN '' ELSE cast(event_id % 17 as string) END) AS item", "event_id % 90 + 10 AS cost", "CASE WHEN event_id % 20 = 2 THEN 150L ELSE 300L END AS budget")


@query("cache_states")
def cache_states(spark, sf_dir):
    """STR-08, STR-11: a cache a user, with stale entries, drops and changes of its budget."""
    return stateful.cache_states(cache_log(spark, sf_dir), "owner")


@query("cache_metrics")
def cache_metrics(spark, sf_dir):
    """STR-13: over all caches."""
    return stateful.metrics(stateful.cache_states(cache_log(spark, sf_dir), "owner"))


@query("cache_hits_unbounded", """WITH e AS (SELECT user_id AS owner, event_id AS seq, event_id % 17 AS item, event_id % 3 = 0 AS put FROM events),
    g AS (SELECT *, max(CASE WHEN put THEN 1 ELSE 0 END) OVER (PARTITION BY owner, item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM e)
    SELECT owner, count(*) FILTER (NOT put)::BIGINT AS lookups, count(*) FILTER (NOT put AND there = 1)::BIGINT AS hits FROM g GROUP BY owner""")
def cache_hits_unbounded(spark, sf_dir):
    """STR-08 with room for all: a lookup hits if its item was ever put."""
    log = table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS action", "cast(event_id % 17 as string) AS item", "1L AS cost", "1000000L AS budget")
    return stateful.cache_states(log, "owner").groupBy("owner").agg(F.max("lookups").alias("lookups"), F.max("hits").alias("hits"))


@query("shared_store_states")
def shared_store_states(spark, sf_dir):
    """STR-09, STR-10: pages of several documents under one budget, with fair reclaim, closing and shrinking."""
    action = "CASE WHEN event_id % 50 = 7 THEN 'budget' WHEN event_id % 50 = 9 THEN 'close' ELSE 'page' END AS action"
    log = table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id AS seq", action, "event_id % 4 AS doc", "event_id % 23 AS src", "event_id % 40 + 20 AS cost", "CASE WHEN event_id % 100 = 7 THEN 250L ELSE 400L END AS budget")
    return stateful.shared_store(log, "owner")


@query("cache_costs", """SELECT c_custkey, 64 + 16 * (c_custkey % 50) + 48 * 2 + strlen(c_name) + strlen(c_mktsegment) AS layout, 64 + 64 * 2 + strlen(c_name) AS links FROM customer""")
def cache_costs(spark, sf_dir):
    """STR-11: what a page's layout and its links count."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", stateful.layout_cost(F.col("c_custkey") % 50, F.array("c_name", "c_mktsegment")).alias("layout"), stateful.links_cost(F.array(F.col("c_name"), F.lit(None))).alias("links"))


@query("hover_phases")
def hover_phases(spark, sf_dir):
    """STR-07: phases that a pointer's events go through."""
    log = table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id * 37 AS ms", "element_at(array('enter', 'enter', 'leave', 'popover', 'leave'), cast(event_id % 5 + 1 as int)) AS action", "concat('k', event_id % 7) AS item", "event_id % 3 * 150 AS load_ms")
    return stateful.hover_phases(log, "owner")


@query("indexing_chains")
def indexing_chains(spark, sf_dir):
    """STR-01, STR-02: one active document, the one in front first; chains, progress and stops."""
    log = table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id AS seq", "CASE WHEN event_id % 9 = 0 THEN 'request' WHEN event_id % 31 = 1 THEN 'front' WHEN event_id % 37 = 2 THEN 'stop' ELSE 'page' END AS action", "event_id % 6 AS doc", "CASE WHEN event_id % 9 = 0 THEN cast(event_id % 70 + 1 as int) END AS pages")
    return stateful.indexing_chains(log, "owner")


@query("position_history")
def position_history(spark, sf_dir):
    """WIN-15: positions to go back to, the last hundred; those of other documents are passed over."""
    log = table(spark, sf_dir, "events").selectExpr("user_id AS owner", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 'pop' ELSE 'push' END AS action", "event_id % 3 AS doc", "value AS top")
    return stateful.position_history(log, "owner")


@query("renders_retried", """WITH j AS (SELECT user_id AS doc, event_id AS seq, event_id % 4 <> 0 AS render FROM events), b AS (SELECT user_id AS doc, event_id AS bump FROM events WHERE event_type = 'error' UNION SELECT user_id, event_id + 1 FROM events WHERE event_id % 3 = 0 UNION SELECT user_id, event_id + 2 FROM events WHERE event_id % 6 = 0),
    h AS (SELECT j.doc, seq, render, list(DISTINCT bump - seq) FILTER (bump IS NOT NULL) AS hits FROM j LEFT JOIN b ON b.doc = j.doc AND bump BETWEEN seq AND seq + 2 GROUP BY ALL),
    f AS (SELECT *, list_filter([0, 1, 2], lambda k: NOT list_contains(coalesce(hits, []), k))[1] AS k FROM h)
    SELECT doc, seq, CASE WHEN NOT render THEN 1 ELSE coalesce(k + 1, 3) END::INT AS tries, CASE WHEN render AND k IS NULL THEN 'cancelled' ELSE 'done' END AS outcome FROM f""")
def renders_retried(spark, sf_dir):
    """STR-12: renders that went stale come again twice at most; other jobs are never stale."""
    events = table(spark, sf_dir, "events")
    jobs = events.selectExpr("user_id AS doc", "event_id AS seq", "event_id % 4 <> 0 AS render")
    bumps = events.where("event_type = 'error'").selectExpr("user_id AS doc", "event_id AS at")
    bumps = bumps.union(events.where("event_id % 3 = 0").selectExpr("user_id", "event_id + 1")).union(events.where("event_id % 6 = 0").selectExpr("user_id", "event_id + 2")).distinct()
    return stateful.retried(jobs, bumps)


@query("queue_order", "SELECT event_id AS seq, (event_id % 9)::BIGINT AS level, row_number() OVER (ORDER BY event_id % 9, event_id) AS turn FROM events")
def queue_order(spark, sf_dir):
    """STR-03, ORD-07: one queue over all documents."""
    return stateful.queue_order(table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_id % 9 AS level")).select("seq", "level", "turn")


@query("mean_page_times", "SELECT event_type AS category, round(sum(value) / nullif(count(DISTINCT user_id), 0), 6) AS per_page, count(DISTINCT user_id) AS pages FROM events GROUP BY event_type")
def mean_page_times(spark, sf_dir):
    """AGG-11: a category's time over its pages, here users."""
    pages = F.count_distinct("user_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.round(F.sum("value") / F.nullif(pages, F.lit(0)), 6).alias("per_page"), pages.alias("pages"))
