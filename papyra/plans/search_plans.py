"""Search: phrases in the library and in documents, and the pruning indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import search
from papyra.plans.text_plans import NORM_SQL
from papyra.registry import query, table
from papyra.sources import store

PATH = "concat('/lib/', source, '/', lpad(cast(doc_id as string), 8, '0'), '.pdf')"
LIB_SQL = f"""SELECT '/lib/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.pdf' AS path, norm, lower(norm) AS folded
  FROM (SELECT doc_id, source, {NORM_SQL} AS norm FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM documents))"""


def library(spark, sf_dir, phrase, *columns):
    """The pages that may hold a phrase, with search text. Of each document the lines are pages."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = docs.select(F.expr(PATH).alias("path"), *columns, F.posexplode(F.split("text", "\n", -1)).alias("src", "raw"))
    return tx.with_search_text(rows.where(tx.may_hold(F.col("raw"), tx.prepare_query(phrase))))


def library_sql(phrase: str, column: str) -> str:
    return f"""WITH h AS (SELECT path, least(20, ((length({column}) - length(replace({column}, '{phrase}', ''))) / {len(phrase)})::BIGINT) AS n FROM ({LIB_SQL}) WHERE contains({column}, '{phrase}')),
    t AS (SELECT path, least(20, sum(n))::BIGINT AS total FROM h GROUP BY path ORDER BY path LIMIT 60) SELECT path, total FROM t"""


@query("library_phrase_search", library_sql("tion", "folded"))
def library_phrase_search(spark, sf_dir):
    """SCH-11, SCH-12, SCH-14, AGG-01, ORD-01, TXT-06, TXT-07."""
    return search.library_search(library(spark, sf_dir, "tion"), "tion")


@query("library_phrase_search_case", library_sql("The ", "norm"))
def library_phrase_search_case(spark, sf_dir):
    """SCH-12, by case: white space at the query's end stays."""
    return search.library_search(library(spark, sf_dir, "The "), "The ", case_sensitive=True)


@query("library_search_truncation", f"WITH h AS (SELECT DISTINCT path FROM ({LIB_SQL}) WHERE contains(folded, 'onsh')), k AS (SELECT max(path) AS last FROM (SELECT path FROM h ORDER BY path LIMIT 60)) SELECT count(*) > 0 AS truncated FROM ({LIB_SQL}) WHERE path > (SELECT last FROM k)")
def library_search_truncation(spark, sf_dir):
    """SCH-12: truncated is whether a document after the last hit stays unexamined."""
    last = search.library_search(library(spark, sf_dir, "onsh"), "onsh").agg(F.max("path").alias("last"))
    paths = table(spark, sf_dir, "documents", "doc_id", "source").select(F.expr(PATH).alias("path"))
    return paths.join(F.broadcast(last), F.col("path") > F.col("last")).agg((F.count("*") > 0).alias("truncated"))


CONV_SQL = rf"SELECT conv_id AS doc, turn AS src, {NORM_SQL.replace('raw', 'text')} AS norm, lower({NORM_SQL.replace('raw', 'text')}) AS folded FROM conversations"


def dialogues(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("src"), F.col("text").alias("raw"))
    return tx.with_search_text(rows)


@query(
    "document_search_capped",
    f"""WITH h AS (SELECT doc, src, ((length(folded) - length(replace(folded, 'th', ''))) / 2)::BIGINT AS n FROM ({CONV_SQL}) WHERE contains(folded, 'th')),
    k AS (SELECT *, greatest(0, least(n, 5, 12 - coalesce(sum(least(n, 5)) OVER (PARTITION BY doc ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept FROM h),
    c AS (SELECT *, bool_or(n > kept) OVER (PARTITION BY doc) AS truncated FROM k)
    SELECT doc, src, kept::BIGINT AS n, truncated FROM c WHERE kept > 0""",
)
def document_search_capped(spark, sf_dir):
    """SCH-13, with caps that bite."""
    return search.document_search(dialogues(spark, sf_dir), "th", per_page=5, per_query=12)


@query(
    "match_snippets",
    f"""WITH RECURSIVE m AS (
      SELECT doc, src, norm, folded, instr(folded, 'tion') AS p FROM ({CONV_SQL}) WHERE contains(folded, 'tion')
      UNION ALL SELECT doc, src, norm, folded, p + 3 + instr(substr(folded, p + 4), 'tion') FROM m WHERE instr(substr(folded, p + 4), 'tion') > 0)
    SELECT doc, src, (p - 1)::INT AS start, 4::INT AS len, substr(norm, greatest(p - 31, 0)::BIGINT + 1, p - 1 + 34 - greatest(p - 31, 0)) AS snippet FROM m""",
)
def match_snippets(spark, sf_dir):
    """TXT-07, TXT-08, TXT-09: raw start and length. No text of the table has white space that normalisation takes away, so SQL
    can take normalised places for raw ones; the kernel's tests hold the rest."""
    return search.match_rows(dialogues(spark, sf_dir), "tion", per_page=100_000)


@query("match_navigation", f"WITH h AS (SELECT doc, src, ((length(folded) - length(replace(folded, 'tion', ''))) / 4)::BIGINT AS n FROM ({CONV_SQL}) WHERE contains(folded, 'tion')) SELECT doc, sum(n)::BIGINT AS n, 0::BIGINT AS first, (sum(n) - 1)::BIGINT AS before_first FROM h GROUP BY doc")
def match_navigation(spark, sf_dir):
    """SCH-22: ordinals over a document's matches, and the step back from the first to the last."""
    from pyspark.sql import Window as W

    rows = search.match_rows(dialogues(spark, sf_dir), "tion", per_page=100_000)
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("doc").orderBy("src", "start")) - 1)
    return rows.groupBy("doc").agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first")).withColumn("before_first", F.pmod(F.col("first") - 1, F.col("n")))


@query(
    "gram_index_build",
    """WITH d AS (SELECT doc_id AS slot, encode(lower(text)) AS b FROM documents), n AS (SELECT greatest(1, ceil(0.15 * count(*))) AS cut FROM d),
    g AS (SELECT DISTINCT slot, hex(b[i:i + 3]) AS gram FROM (SELECT slot, b, unnest(range(1, octet_length(b) - 2)) AS i FROM d))
    SELECT gram, count(*)::BIGINT AS df, count(*) > (SELECT cut FROM n) AS dropped FROM g GROUP BY gram""",
)
def gram_index_build(spark, sf_dir):
    """SCH-05, AGG-12: how many documents hold a gram, and whether it is dropped."""
    return search.gram_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"), F.lower("text").alias("folded")))


def gram_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"), F.lower("text").alias("folded"))


@query("gram_postings", """WITH d AS (SELECT doc_id AS slot, encode(lower(text)) AS b FROM documents), n AS (SELECT greatest(1, ceil(0.15 * count(*))) AS cut FROM d),
    g AS (SELECT DISTINCT slot, hex(b[i:i + 3]) AS gram FROM (SELECT slot, b, unnest(range(1, octet_length(b) - 2)) AS i FROM d))
    SELECT gram, count(*)::BIGINT AS n, min(slot) AS first, max(slot) AS last, sum(slot)::BIGINT AS total FROM g GROUP BY gram HAVING count(*) <= (SELECT cut FROM n)""")
def gram_postings(spark, sf_dir):
    """SCH-07, SCH-08: the lists of slots of all grams that are kept, by count, ends and sum."""
    docs = gram_documents(spark, sf_dir)
    rows = search.gram_postings(docs, search.gram_index(docs)).select("gram", F.explode("slots").alias("slot"))
    return rows.groupBy(F.lpad(F.hex("gram"), 8, "0").alias("gram")).agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.sum("slot").alias("total"))


def _candidates(phrase: str):
    def run(spark, sf_dir):
        """SCH-09, SET-02, SET-03: from the stored index, with a document without text as one that may hold anything."""
        docs = gram_documents(spark, sf_dir)
        stored = store.gram_index(spark, docs)
        always = docs.where(F.col("folded").isNull())
        kind, found = search.gram_candidates(*stored, always, phrase)
        return docs.select("slot") if found is None else found

    return run


def _candidates_sql(phrase: str) -> str:
    grams = ", ".join(f"'{phrase[i : i + 4]}'" for i in range(len(phrase) - 3))
    return f"""WITH d AS (SELECT doc_id AS slot, lower(text) AS t FROM documents), q AS (SELECT DISTINCT unnest([{grams}]) AS g),
    f AS (SELECT g, (SELECT count(*) FROM d WHERE contains(t, g)) AS df FROM q), u AS (SELECT g FROM f WHERE df <= (SELECT greatest(1, ceil(0.15 * count(*))) FROM d))
    SELECT slot FROM d WHERE t IS NULL OR (NOT EXISTS (SELECT 1 FROM f WHERE df = 0) AND NOT EXISTS (SELECT 1 FROM u WHERE NOT contains(d.t, u.g)))"""


query("gram_candidates", _candidates_sql("ononwhsh"))(_candidates("ononwhsh"))
query("gram_candidates_absent", _candidates_sql("zzzznotthere"))(_candidates("zzzznotthere"))
query("gram_candidates_unknown", "SELECT doc_id AS slot FROM documents")(_candidates("abc"))


@query("library_hits", f"""WITH l AS (SELECT '/lib/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.pdf' AS path, src, raw, lower(raw) AS folded FROM (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS src, unnest(string_split(text, chr(10))) AS raw FROM documents)),
    h AS (SELECT path, src, least(20, ((length(folded) - length(replace(folded, 'onsh', ''))) / 4)::BIGINT) AS n FROM l WHERE contains(folded, 'onsh')),
    t AS (SELECT path, least(20, sum(n))::BIGINT AS total FROM h GROUP BY path ORDER BY path LIMIT 60),
    k AS (SELECT h.*, total, 20 - coalesce(sum(n) OVER (PARTITION BY path ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM h JOIN t USING (path)),
    r AS (SELECT path, row_number() OVER (ORDER BY total DESC, path[-12:], path) AS rank FROM t)
    SELECT rank::INT AS rank, path, path[-12:] AS name, total, src::INT AS src, least(n, room)::INT AS n FROM k JOIN r USING (path) WHERE room > 0""")
def library_hits(spark, sf_dir):
    """SCH-11, SCH-12, SCH-23, ORD-01: ranked documents with name, total and pages; matches as raw starts, lengths and snippets."""
    name = F.expr("concat(lpad(cast(doc_id as string), 8, '0'), '.pdf')").alias("name")
    hits = search.library_hits(library(spark, sf_dir, "onsh", name), "onsh")
    return hits.select("rank", "path", "name", "total", F.inline("pages")).select("rank", "path", "name", "total", "src", F.size("matches").alias("n"))


@query("library_match_places")
def library_match_places(spark, sf_dir):
    """SCH-12: each match of the ranked documents, with its snippet."""
    name = F.expr("concat(lpad(cast(doc_id as string), 8, '0'), '.pdf')").alias("name")
    hits = search.library_hits(library(spark, sf_dir, "tion a", name), "Tion  a")
    return hits.select("rank", "path", F.inline("pages")).select("rank", "path", "src", F.inline("matches"))


@query("library_search_pruned", library_sql("ononwhsh", "folded"))
def library_search_pruned(spark, sf_dir):
    """SCH-09, SCH-12, JON-03: the index's candidates by semi join, then trigrams, then the scan; the rows of an unpruned search."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("slot", F.col("doc_id"))
    texts = docs.select("slot", F.lower("text").alias("folded"))
    kind, found = search.gram_candidates(*store.gram_index(spark, texts), texts.where(F.col("folded").isNull()), "ononwhsh")
    if found is not None:
        docs = docs.join(found, "slot", "left_semi")
    bits = search.trigram_bitmaps(docs, "slot", "text")
    docs = docs.join(bits.where(search.bitmap_admits(F.col("bits"), "ononwhsh")), "slot", "left_semi")
    pages = docs.select(F.expr(PATH).alias("path"), F.explode(F.split("text", "\n", -1)).alias("raw"))
    return search.library_search(tx.with_search_text(pages.where(tx.may_hold(F.col("raw"), "ononwhsh"))), "ononwhsh")


@query("stored_page_filter", r"""SELECT conv_id, turn, contains(text, 'tion') AS plain, true AS escaped FROM conversations""")
def stored_page_filter(spark, sf_dir):
    """SCH-10: the bytes of a stored page against the query; a query with a quotation mark can't be told."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", search.worth_reading(F.col("text"), "tion").alias("plain"), search.worth_reading(F.col("text"), 'a"b').alias("escaped"))


SYMBOLS_SQL = "translate(upper(regexp_replace({text}, '[^A-Za-z0-9\\x09-\\x0D\\x20]', ']', 'g')), '0123456789 ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '[[[[[[[[[[' || repeat(chr(92), 6))"


@query("trigram_admission", f"WITH s AS (SELECT doc_id, {SYMBOLS_SQL.format(text='text')} AS s FROM documents) SELECT doc_id, contains(s, 'TIO') AND contains(s, 'ION') AND contains(s, 'ON' || chr(92)) AND contains(s, 'N' || chr(92) || 'A') AS admitted FROM s")
def trigram_admission(spark, sf_dir):
    """SCH-01, SCH-02, SCH-04: on the bitmap of each document, here of its text as one page."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.translate("text", "\n", " "))
    return search.trigram_bitmaps(docs, "doc_id", "text").select("doc_id", search.bitmap_admits(F.col("bits"), "Tion a").alias("admitted"))


@query("trigram_bitmap_popcount", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), s AS (SELECT doc_id, {SYMBOLS_SQL.format(text='raw')} AS s FROM l),
    t AS (SELECT doc_id, substr(s, i, 3) AS t FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM s)), n AS (SELECT doc_id, count(DISTINCT t) AS n FROM t GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS bits FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""")
def trigram_bitmap_popcount(spark, sf_dir):
    """SCH-03, SNK-04: 4096-byte bitmaps, one for each document, and how many bits are set."""
    return search.trigram_bitmaps(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.bitmap_count("bits").alias("bits"))
