"""Ranking: fuzzy scores, sections of the command palette and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import ranking
from papyra.registry import query, table

NAMES = ["File", "Edit", "View", "Tabs", "Page", "Odd"]


def candidates(spark, sf_dir):
    """Parts as commands: a few hundred titles repeat, a tenth is disabled."""
    group = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_size") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("cmd:"), "p_partkey").alias("key"), F.concat_ws(" ", F.initcap("p_name"), F.lower("p_type")).alias("title"), group.alias("group"),
        F.array(F.lower("p_brand"), F.lower("p_type")).alias("keywords"), (F.col("p_partkey") % 10 != 3).alias("enabled"), (F.col("p_partkey") % 23).alias("uses"), F.col("p_partkey").alias("at"),
    )


CANDIDATES_SQL = f"""SELECT 'cmd:' || p_partkey AS key, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || lower(p_type) AS title,
    {NAMES}[p_size % {len(NAMES)} + 1] AS "group", p_partkey % 10 <> 3 AS enabled, p_partkey % 23 AS uses, p_partkey AS "at" FROM part"""


@query("fuzzy_scores")
def fuzzy_scores(spark, sf_dir):
    """SCH-15, SCH-16: all commands against a query that is no prefix; null where it does not occur."""
    rows = candidates(spark, sf_dir)
    return rows.select("key", ranking.score(F.col("title"), F.array().cast("array<string>"), "rgp").alias("of_title"), ranking.score(F.col("title"), F.col("keywords"), "bra").alias("of_all"))


@query("prefix_scores", f"SELECT key, CASE WHEN starts_with(lower(title), 'red ') THEN 1000 + 200.0::DOUBLE / (1 + length(title)) END AS score FROM ({CANDIDATES_SQL}) WHERE starts_with(lower(title), 'red ')")
def prefix_scores(spark, sf_dir):
    """SCH-15: prefixes alone, whose score SQL can state."""
    rows = candidates(spark, sf_dir).where(F.startswith(F.lower("title"), F.lit("red ")))
    return rows.select("key", ranking.score(F.col("title"), F.array().cast("array<string>"), "red ").alias("score"))


@query("usage_boosts", f"SELECT key, CASE WHEN uses <= 0 THEN 0.0::DOUBLE ELSE least(40.0::DOUBLE, round(log2(uses + 1.0::DOUBLE) * 12, 9)) END AS boost FROM ({CANDIDATES_SQL})")
def usage_boosts(spark, sf_dir):
    """SCH-17, rounded."""
    return candidates(spark, sf_dir).select("key", F.round(ranking.usage_boost(F.col("uses")), 9).alias("boost"))


@query("ranked_sections")
def ranked_sections(spark, sf_dir):
    """SCH-18, SCH-20, CMP-05: a typed query, with each row's place in draw order."""
    return ranking.numbered(ranking.ranked_sections(candidates(spark, sf_dir), "blue w"))


RECENTS = "p_partkey % 97 = 5"


@query(
    "default_sections",
    f"""WITH c AS (SELECT * FROM ({CANDIDATES_SQL}) WHERE enabled), u AS (SELECT key, row_number() OVER (ORDER BY "at" DESC) AS rank FROM c WHERE "at" % 97 = 5 ORDER BY "at" DESC LIMIT 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY "at") AS rank FROM c WHERE key NOT IN (SELECT key FROM u)),
    f AS (SELECT "group", row_number() OVER (ORDER BY coalesce(list_position({ranking.GROUPS}, "group"), 99), "at") AS section FROM r WHERE rank = 1),
    s AS (SELECT 0 AS section, 'Recent' AS "group", rank, key, title FROM u JOIN c USING (key) UNION ALL SELECT section, "group", rank, key, title FROM r JOIN f USING ("group") WHERE rank <= 5)
    SELECT section::INT AS section, "group", rank::INT AS rank, key, title, (row_number() OVER (ORDER BY section, rank) - 1)::INT AS position FROM s""",
)
def default_sections(spark, sf_dir):
    """SCH-19, SCH-20, CMP-05: nothing typed; recents first, then groups in fixed order."""
    rows = candidates(spark, sf_dir)
    recent = table(spark, sf_dir, "part", "p_partkey").where(RECENTS).select(F.concat(F.lit("cmd:"), "p_partkey").alias("key"), (-F.col("p_partkey")).alias("at"))
    return ranking.numbered(ranking.default_sections(rows, recent))


@query("page_jump_section", f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY "at") AS rank FROM ({CANDIDATES_SQL}) WHERE enabled) WHERE rank = 1),
    s AS (SELECT row_number() OVER (ORDER BY coalesce(list_position({ranking.GROUPS}, "group"), 99), "at") AS section, "group", rank, key, title FROM r UNION ALL SELECT -1, 'Jump', 1, 'page:12', 'Go to page 12')
    SELECT section::INT AS section, "group", rank::INT AS rank, key, title FROM s""")
def page_jump_section(spark, sf_dir):
    """CMP-04: a bare page number comes before all else."""
    rows = candidates(spark, sf_dir)
    none = rows.select("key", "at").limit(0)
    return ranking.with_page_jump(ranking.default_sections(rows, none, 1), " 12 ", 30)


@query("usage_counts")
def usage_counts(spark, sf_dir):
    """SCH-21: the 60 counts kept of each user after each use, in their order."""
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat("event_type", F.lit(":"), (F.col("event_id") % 29).cast("string")).alias("id"))
    return ranking.most_used(log, "user_id")


@query("most_used_commands", """WITH c AS (SELECT user_id, event_type AS id, count(*) AS uses, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, max(uses)::BIGINT AS uses, count(*)::INT AS kinds FROM c GROUP BY user_id""")
def most_used_commands(spark, sf_dir):
    """SCH-21 where no count is ever dropped: the largest count and how many ids there are."""
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("id"))
    return ranking.most_used(log, "user_id").groupBy("user_id").agg(F.max("uses").alias("uses"), F.count("*").cast("int").alias("kinds"))


@query("palette_candidates", """SELECT 'cmd:' || p_partkey AS key, p_name AS title, 'File' AS "group", NULL AS context FROM part
    UNION ALL SELECT 'tab:' || s_suppkey, s_name, 'Tabs', NULL FROM supplier WHERE s_name <> ''
    UNION ALL SELECT 'sec:' || (event_id % 50) || ':' || trim(event_type || ' '), trim(event_type || ' '), 'Sections', 'p. ' || (event_id % 50 + 1) FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT 'env:' || (doc_id % 40) || ':' || (doc_id % 900), lang, CASE WHEN doc_id % 2 = 0 THEN 'Sections' ELSE 'Environments' END, 'p. ' || (doc_id % 40 + 1) FROM documents WHERE trim(lang) <> ''""")
def palette_candidates(spark, sf_dir):
    """CMP-03: commands, named tabs, outline nodes with a page, and structure entries, as one list."""
    none = F.lit(None).cast("string").alias("context")
    commands = table(spark, sf_dir, "part").select(F.concat(F.lit("cmd:"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.lit("File").alias("group"), none)
    tabs = table(spark, sf_dir, "supplier").where("s_name <> ''").select(F.concat(F.lit("tab:"), "s_suppkey").alias("key"), F.col("s_name").alias("title"), F.lit("Tabs").alias("group"), none)
    shown = lambda page: F.concat(F.lit("p. "), page + 1).alias("context")
    page = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50)
    title = F.trim(F.concat("event_type", F.lit(" ")))
    outline = table(spark, sf_dir, "events").where((title != "") & page.isNotNull()).select(F.concat(F.lit("sec:"), page, F.lit(":"), title).alias("key"), title.alias("title"), F.lit("Sections").alias("group"), shown(page))
    page, label = F.col("doc_id") % 40, F.trim("lang")
    group = F.when(F.col("doc_id") % 2 == 0, "Sections").otherwise("Environments")
    formal = table(spark, sf_dir, "documents", "doc_id", "lang").where(label != "").select(F.concat(F.lit("env:"), page, F.lit(":"), F.col("doc_id") % 900).alias("key"), label.alias("title"), group.alias("group"), shown(page))
    return commands.unionByName(tabs).unionByName(outline).unionByName(formal)
