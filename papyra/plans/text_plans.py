"""Scalar kernels over the driver's tables: normalisation, identifiers, headings, formats, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import citations, formats, headings, validate
from papyra.functions import text as tx
from papyra.registry import query, table

#: The pages of a document are its lines.
PAGES_SQL = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS src, unnest(string_split(text, chr(10))) AS raw FROM documents"
#: On the driver's texts normalisation is collapsing white space, and folding lower(): the kernels' tests hold the rest.
NORM_SQL = r"regexp_replace(regexp_replace(raw, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+', ' ', 'g')"


def pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("src", "raw"))


@query("normalized_pages", f"SELECT doc_id, src::INT AS src, {NORM_SQL} AS normalized, lower({NORM_SQL}) AS folded FROM ({PAGES_SQL})")
def normalized_pages(spark, sf_dir):
    """TXT-01, TXT-04, SRC-08."""
    return tx.with_search_text(pages(spark, sf_dir)).select("doc_id", "src", "normalized", "folded")


@query(
    "page_costs",
    rf"""WITH n AS (SELECT doc_id, src, raw, {NORM_SQL} AS norm,
           regexp_extract_all(regexp_replace(raw, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]{{2,}}[^\x09-\x0D\x20]') AS runs FROM ({PAGES_SQL}))
    SELECT doc_id, src::INT AS src, (64 + strlen(norm) + strlen(lower(norm)) + 8 * (len(runs) + CASE WHEN norm = '' THEN 0 ELSE 1 END))::BIGINT AS cost FROM n""",
)
def page_costs(spark, sf_dir):
    """TXT-02, TXT-05: the cost of a page counts its offset map."""
    rows = tx.with_search_text(pages(spark, sf_dir), breaks=True)
    return rows.select("doc_id", "src", tx.page_cost(F.col("normalized"), F.col("folded"), F.col("breaks")).cast("long").alias("cost"))


@query("offset_breaks_by_page")
def offset_breaks_by_page(spark, sf_dir):
    """TXT-02, TXT-03: offset maps of synthesised ragged pages, and the raw index of the last character."""
    raw = F.concat(F.lit("  "), F.replace(F.col("raw"), F.lit(". "), F.lit(".  \t")))
    rows = tx.with_search_text(pages(spark, sf_dir).withColumn("raw", raw), breaks=True)
    last = F.greatest(F.char_length("normalized") - 1, F.lit(0))
    return rows.select("doc_id", "src", F.transform("breaks", lambda b: F.concat_ws(":", b["at"], b["delta"])).alias("breaks"), tx.offset_lookup(F.col("breaks"), last).alias("last_raw"))


SYNTH = "concat('see doi:10.', 1000 + doc_id % 9000, '/Ab', doc_id, '. and arXiv:2401.', lpad(cast(doc_id % 100000 as string), 5, '0'), 'v2 or https://arxiv.org/abs/math.GT/', lpad(cast(doc_id % 10000000 as string), 7, '0'))"
SYNTH_SQL = "'see doi:10.' || (1000 + doc_id % 9000) || '/Ab' || doc_id || '. and arXiv:2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v2 or https://arxiv.org/abs/math.GT/' || lpad((doc_id % 10000000)::VARCHAR, 7, '0')"


@query(
    "citations_extracted",
    f"""WITH t AS (SELECT doc_id, {SYNTH_SQL} AS text FROM documents)
    SELECT doc_id, 0::INT AS ord, 'doi' AS scheme, lower(regexp_extract(text, 'doi:(10\\.[0-9]{{4,9}}/[A-Za-z0-9._;()/:,-]*[A-Za-z0-9_(/:-])', 1)) AS value FROM t
    UNION ALL SELECT doc_id, 1, 'arxiv', regexp_extract(text, 'arXiv:([0-9]{{4}}\\.[0-9]{{4,5}})', 1) FROM t
    UNION ALL SELECT doc_id, 2, 'arxiv', regexp_extract(text, 'abs/([A-Za-z0-9.-]{{1,25}}/[0-9]{{7}})', 1) FROM t""",
)
def citations_extracted(spark, sf_dir):
    """TXT-10 to TXT-13."""
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("text", F.expr(SYNTH))
    return docs.select("doc_id", F.posexplode(citations.explicit(F.col("text"))).alias("ord", "id")).select("doc_id", "ord", "id.scheme", "id.value")


@query(
    "citation_spans",
    f"""WITH t AS (SELECT doc_id, {SYNTH_SQL} AS text FROM documents),
    h AS (SELECT doc_id, text, unnest([regexp_extract(text, 'doi:10\\.[0-9]+/Ab[0-9]+'), regexp_extract(text, 'arXiv:[0-9.]+v2'), regexp_extract(text, 'https://arxiv.org/abs/math.GT/[0-9]{{7}}')]) AS hit FROM t)
    SELECT doc_id, (instr(text, hit) - 1)::INT AS start, length(hit)::INT AS len FROM h""",
)
def citation_spans(spark, sf_dir):
    """TXT-13: where each identifier stands."""
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("text", F.expr(SYNTH))
    return docs.select("doc_id", F.explode(citations.spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.len")


@query("single_identifier", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.' || (1000 + doc_id) || '/x' WHEN doc_id % 3 = 1 THEN 'arxiv:2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') END AS key, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.' || (1000 + doc_id) || '/x' WHEN doc_id % 3 = 1 THEN 'arXiv:2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') END AS label FROM documents WHERE doc_id < 100000000")
def single_identifier(spark, sf_dir):
    """TXT-14, TXT-44."""
    text = F.expr("case doc_id % 3 when 0 then concat(' <10.', 1000 + doc_id, '/X,> ') when 1 then concat('2401.', lpad(cast(doc_id % 100000 as string), 5, '0'), 'v3') else concat('no ', doc_id) end")
    docs = table(spark, sf_dir, "documents", "doc_id").withColumn("id", citations.parse(text))
    return docs.select("doc_id", F.when(F.col("id").isNotNull(), citations.key(F.col("id"))).alias("key"), citations.label(F.col("id")).alias("label"))


@query("filename_ids", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'arxiv' ELSE 'doi' END AS scheme, CASE WHEN s_suppkey % 2 = 0 THEN '2401.' || lpad((s_suppkey % 100000)::VARCHAR, 5, '0') ELSE '10.' || (1000 + s_suppkey % 9000) || '/a_' || s_suppkey END AS value FROM supplier")
def filename_ids(spark, sf_dir):
    """TXT-15, SRC-11."""
    name = F.expr("case s_suppkey % 2 when 0 then concat('arXiv-2401.', lpad(cast(s_suppkey % 100000 as string), 5, '0'), 'v2.pdf') else concat('copy 10.', 1000 + s_suppkey % 9000, '_A_', s_suppkey, '.pdf') end")
    return table(spark, sf_dir, "supplier", "s_suppkey").withColumn("id", citations.from_filename(name)).select("s_suppkey", "id.scheme", "id.value")


@query(
    "first_page_metadata",
    f"""WITH t AS (SELECT doc_id, {SYNTH_SQL} AS ids, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 12) AS long FROM documents)
    SELECT doc_id, lower(regexp_extract(ids, 'doi:(10\\.[0-9]+/Ab[0-9]+)', 1)) AS doi, regexp_extract(ids, 'arXiv:([0-9.]+)v2', 1) AS arxiv, left(coalesce(long[1], ids), 300) AS title FROM t""",
)
def first_page_metadata(spark, sf_dir):
    """TXT-16."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    page = citations.first_page(F.concat(F.col("text"), F.lit("\n"), F.expr(SYNTH)))
    return docs.select("doc_id", page.alias("p")).select("doc_id", "p.*")


@query(
    "snippet_parts",
    r"""WITH t AS (SELECT doc_id, text AS s, string_split(regexp_replace(text, '(?i)of\s+the', chr(1), 'g'), chr(1)) AS p FROM documents)
    SELECT doc_id, len(regexp_extract_all(s, '(?i)of\s+the'))::INT AS n_match, (CASE WHEN len(p) = 1 THEN 1 ELSE len(list_filter(p, lambda x: x <> '')) END)::INT AS n_plain FROM t""",
)
def snippet_parts(spark, sf_dir):
    """TXT-17, of all documents and whole texts; an empty part between hits is none."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", formats.snippet_parts(F.col("text"), "of  the").alias("p"))
    count = lambda flag: F.size(F.filter("p", lambda x: x["match"] == flag))
    return rows.select("doc_id", count(True).alias("n_match"), count(False).alias("n_plain"))


@query("script_plain_text", "SELECT p_partkey, p_size || 'xmax' || p_partkey || ' y2 ' || 'z' AS plain FROM part")
def script_plain_text(spark, sf_dir):
    """TXT-18, JVM-side."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", formats.plain_script(F.expr("concat(p_size, 'x_{max}^{', p_partkey, '} y^2 z')")).alias("plain"))


@query("script_segments", "SELECT p_partkey, [p_size || 'x', 'max', p_partkey::VARCHAR, ' y', '2', ' z_'] AS texts, ['normal', 'sub', 'super', 'normal', 'super', 'normal'] AS kinds FROM part")
def script_segments(spark, sf_dir):
    """TXT-18, segments."""
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("s", formats.script_markup(F.expr("concat(p_size, 'x_{max}^{', p_partkey, '} y^2 z_')")))
    return rows.select("p_partkey", F.transform("s", lambda x: x["text"]).alias("texts"), F.transform("s", lambda x: x["kind"]).alias("kinds"))


@query("glyph_expansion", "SELECT p_partkey, 'offi' || p_name || 'fflst' AS text FROM part")
def glyph_expansion(spark, sf_dir):
    """TXT-19."""
    return table(spark, sf_dir, "part").select("p_partkey", formats.expand_ligatures(F.concat(F.lit("oﬃ"), "p_name", F.lit("ﬄﬆ"))).alias("text"))


@query("math_fonts", "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS math FROM part")
def math_fonts(spark, sf_dir):
    """TXT-20."""
    name = F.expr("case p_partkey % 3 when 0 then concat('EWJNXA+cmmi', p_size) when 1 then 'LatinModernMath-Italic' else concat('CMMIXX+Times', p_size) end")
    return table(spark, sf_dir, "part").select("p_partkey", formats.is_math_font(name).alias("math"))


@query("link_texts", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS text FROM pages")
def link_texts(spark, sf_dir):
    """TXT-21."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", formats.link_text(F.col("url")).alias("text"))


DEST = "element_at(array('section.', 'subsection.', 'theorem.', 'page.', 'cite.', 'appendix.', 'table.of.', 'Doc-Start'), cast(o_orderkey % 8 as int) + 1)"
DEST_SQL = "(['section.', 'subsection.', 'theorem.', 'page.', 'cite.', 'appendix.', 'table.of.', 'Doc-Start'])[o_orderkey % 8 + 1]"


@query(
    "destination_counters",
    f"""WITH d AS (SELECT o_orderkey, o_orderkey % 8 AS k, CASE WHEN o_orderkey % 8 = 7 THEN {DEST_SQL} WHEN o_orderkey % 8 = 6 THEN {DEST_SQL} || 'contents' ELSE {DEST_SQL} || (1 + o_orderkey % 9) || '.A' END AS name FROM orders)
    SELECT o_orderkey, k IN (3, 4, 7) AS structural, CASE WHEN k IN (0, 5) THEN 0 WHEN k = 1 THEN 1 END::INT AS depth, CASE WHEN k < 6 THEN (1 + o_orderkey % 9) || '.A' END AS number FROM d""",
)
def destination_counters(spark, sf_dir):
    """TXT-22 to TXT-24, SRC-14."""
    name = F.expr(f"case o_orderkey % 8 when 7 then {DEST} when 6 then concat({DEST}, 'contents') else concat({DEST}, 1 + o_orderkey % 9, '.A') end")
    rows = table(spark, sf_dir, "orders", "o_orderkey").withColumn("name", name)
    return rows.select("o_orderkey", headings.is_structural(F.col("name")).alias("structural"), headings.heading_depth(F.col("name")).alias("depth"), headings.destination_number(F.col("name")).alias("number"))


@query("structural_filter", f"SELECT count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS first FROM orders WHERE o_orderkey % 8 NOT IN (3, 4, 7)")
def structural_filter(spark, sf_dir):
    """TXT-22 as a filter."""
    rows = table(spark, sf_dir, "orders", "o_orderkey").withColumn("name", F.expr(f"concat({DEST}, case when o_orderkey % 8 = 7 then '' else '1' end)"))
    return rows.where(~headings.is_structural(F.col("name"))).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query(
    "heading_rows",
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'Theorem' WHEN doc_id % 4 = 2 THEN 'Lemma' END AS kind, CASE WHEN doc_id % 4 = 0 THEN (1 + doc_id % 5) || '.' || (doc_id % 9) WHEN doc_id % 4 = 1 THEN 'A.' || (doc_id % 9) WHEN doc_id % 4 = 2 THEN (doc_id % 9)::VARCHAR END AS number FROM documents""",
)
def heading_rows(spark, sf_dir):
    """TXT-25: a counter is never taken in part, so `1.2a` is none."""
    line = F.expr("case doc_id % 4 when 0 then concat(' Theorem ', 1 + doc_id % 5, '.', doc_id % 9, '. text') when 1 then concat('Theorem A.', doc_id % 9, ' (Main)') when 2 then concat('Lemma ', doc_id % 9) else concat('Theorem 1.', doc_id % 9, 'a') end")
    return table(spark, sf_dir, "documents", "doc_id").withColumn("h", headings.heading(line)).select("doc_id", "h.kind", "h.number")


@query("heading_search", "SELECT doc_id, doc_id % 2 = 0 AS found FROM documents")
def heading_search(spark, sf_dir):
    """TXT-26: the first heading whose number is the wanted one."""
    text = F.expr("concat('As in Lemma 9.9, see Proposition 2.', doc_id % 7, ' for more.')")
    wanted = F.expr("case when doc_id % 2 = 0 then concat('2.', doc_id % 7) else '3.1' end")
    starts = F.regexp_extract_all(text, F.lit(r"(?:^|\s)(\p{Lu}\p{L}{2,}+\s*+(?:[A-Z]{1,3}+|\d++)(?:\.\d++)*+)(?![A-Za-z0-9])"), F.lit(1))
    found = F.exists(starts, lambda s: F.regexp_extract(s, headings.HEADING, 2) == wanted)
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", found.alias("found"))


@query("counter_openings", "SELECT doc_id, doc_id % 3 <> 2 AS opens FROM documents")
def counter_openings(spark, sf_dir):
    """TXT-27."""
    counter = F.expr("concat(1 + doc_id % 9, '.2')")
    line = F.expr("case doc_id % 3 when 0 then concat(' ', 1 + doc_id % 9, '.2. Title') when 1 then concat(1 + doc_id % 9, '.2) é') else concat(1 + doc_id % 9, '.23') end")
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", headings.opens_with_counter(line, counter).alias("opens"))


@query("caption_rows", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Figure ' || (doc_id % 20) WHEN doc_id % 3 = 1 THEN 'TABLE 2.' || (doc_id % 9) END AS label, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '' END AS title FROM documents")
def caption_rows(spark, sf_dir):
    """TXT-28."""
    line = F.expr("case doc_id % 3 when 0 then concat('Figure ', doc_id % 20, ': ', lang) when 1 then concat('  TABLE 2.', doc_id % 9) else concat('Figure ', doc_id % 20, ' computes ', lang) end")
    return table(spark, sf_dir, "documents", "doc_id", "lang").withColumn("c", headings.caption(line)).select("doc_id", "c.label", "c.title")


@query(
    "truncated_titles",
    """WITH t AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 140 THEN t WHEN instr(left(t, 140), ' ') > 0 THEN rtrim(regexp_replace(left(t, 140), ' [^ ]*$', '')) || '…' ELSE left(t, 140) || '…' END AS title FROM t""",
)
def truncated_titles(spark, sf_dir):
    """TXT-29."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", headings.truncate_words(F.get(F.split("text", "\n"), F.lit(0))).alias("title"))


@query("url_sanitize", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE url END AS url FROM pages")
def url_sanitize(spark, sf_dir):
    """TXT-31: the addresses here are in normal form already; the kernel's tests hold the rest."""
    raw = F.expr("case page_id % 4 when 0 then url when 1 then concat('  ', url, ' ') when 2 then concat(upper(substring_index(url, ':', 1)), substring(url, instr(url, ':'))) else concat('javascript:', url) end")
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", validate.sanitized_url(raw).alias("url"))


@query("url_hosts", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def url_hosts(spark, sf_dir):
    """TXT-32."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", validate.url_host(F.col("url")).alias("host"))


@query(
    "trusted_hosts",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages),
    t AS (SELECT DISTINCT host FROM h WHERE page_id % 10 = 0)
    SELECT page_id, host, host IN (SELECT host FROM t) AS trusted FROM h""",
)
def trusted_hosts(spark, sf_dir):
    """TXT-33: membership in a set of hosts kept without duplicates."""
    rows = table(spark, sf_dir, "pages", "page_id", "url").withColumn("host", validate.url_host(F.col("url")))
    trusted = rows.where(F.col("page_id") % 10 == 0).select("host").distinct().withColumn("t", F.lit(True))
    return rows.join(trusted, "host", "left").select("page_id", "host", F.coalesce("t", F.lit(False)).alias("trusted"))


RANGE = "element_at(array('3', '2-5', concat('1,', 2 + o_orderkey % 5, '-9'), '5-2', '0-4', '1, 2', '', concat('x', o_orderkey % 3)), cast(o_orderkey % 8 as int) + 1)"
RANGE_SQL = "(['3', '2-5', '1,' || (2 + o_orderkey % 5) || '-9', '5-2', '0-4', '1, 2', '', 'x' || (o_orderkey % 3)])[o_orderkey % 8 + 1]"


@query("page_range_validate", "SELECT o_orderkey, o_orderkey % 8 <= 2 AS valid FROM orders")
def page_range_validate(spark, sf_dir):
    """TXT-34."""
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", validate.is_page_range(F.expr(RANGE)).alias("valid"))


@query(
    "page_range_diagnosis",
    f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'This document has 8 pages.' WHEN 3 THEN '"5-2" runs backwards.' WHEN 4 THEN 'Pages start at 1.'
    WHEN 5 THEN 'Ranges cannot contain spaces.' WHEN 6 THEN 'Enter a range like 1-4, or choose All.' ELSE '"x' || (o_orderkey % 3) || '" is not a page or a range.' END AS problem FROM orders""",
)
def page_range_diagnosis(spark, sf_dir):
    """TXT-35."""
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", validate.range_problem(F.expr(RANGE), F.lit(8)).alias("problem"))


@query("page_range_expand", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN [2] WHEN 1 THEN [1, 2, 3, 4] WHEN 2 THEN list_prepend(0, range(1 + o_orderkey % 5, 9)) END::INT[] AS pages FROM orders")
def page_range_expand(spark, sf_dir):
    """TXT-36."""
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", validate.pages_in_range(F.expr(RANGE), F.lit(9)).alias("pages"))


@query("printer_parse", "SELECT s_suppkey, ['Lab_' || s_suppkey, 'HP.2'] AS names, ['false', 'true'] AS defaults FROM supplier")
def printer_parse(spark, sf_dir):
    """TXT-37."""
    text = F.expr("concat('printer Lab_', s_suppkey, ' is idle.  enabled\\nprinter -d is idle\\nnoise\\nprinter HP.2 now printing')")
    rows = table(spark, sf_dir, "supplier", "s_suppkey").withColumn("p", validate.printers(text, F.lit("system default destination: HP.2")))
    return rows.select("s_suppkey", F.transform("p", lambda x: x["name"]).alias("names"), F.transform("p", lambda x: x["is_default"].cast("string")).alias("defaults"))


@query("printer_options", "SELECT s_suppkey, 'PageSize' AS key, 'Media Size' AS label, ['A' || (s_suppkey % 5), 'Letter'] AS choices, 'Letter' AS default_choice FROM supplier")
def printer_options(spark, sf_dir):
    """TXT-38: options with one usable choice, or an unsafe key, go."""
    text = F.expr("concat('PageSize/Media Size: A', s_suppkey % 5, ' *Letter\\nOne/One: *only\\n-x/Bad: a b\\nnoise')")
    rows = table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.explode(validate.printer_options(text)).alias("o"))
    return rows.select("s_suppkey", "o.key", "o.label", "o.choices", F.col("o.default").alias("default_choice"))


@query("option_labels", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Two-sided' WHEN 1 THEN 'Tray ' || s_suppkey ELSE 'Other' END AS label, 'Long Edge' AS choice FROM supplier")
def option_labels(spark, sf_dir):
    """TXT-39."""
    key = F.expr("element_at(array('Duplex', 'InputSlot', 'Other'), cast(s_suppkey % 3 as int) + 1)")
    reported = F.expr("case s_suppkey % 3 when 1 then concat('Tray ', s_suppkey) else '' end")
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", formats.option_label({"Duplex": "Two-sided"}, key, reported).alias("label"), formats.humanized(F.lit("LongEdge")).alias("choice"))


@query(
    "size_formats",
    """WITH t AS (SELECT o_orderkey, (o_totalprice * (10 ** (o_orderkey % 5)))::BIGINT AS n FROM orders), v AS (SELECT o_orderkey, n, n / (CASE WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END)::DOUBLE AS v FROM t)
    SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' ELSE (CASE WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5)::DOUBLE / 10) ELSE printf('%.0f', floor(v + 0.5)::DOUBLE) END) || CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END END AS size FROM v""",
)
def size_formats(spark, sf_dir):
    """TXT-40, of all orders; ties are rounded up. Bytes are whole: half of one goes to the even number, as in the SQL's cast."""
    rows = table(spark, sf_dir, "orders").withColumn("n", F.rint(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 5)).cast("long"))
    return rows.select("o_orderkey", formats.byte_size(F.col("n")).alias("size"))


@query("date_formats", "SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-01' THEN ltrim(strftime(ts, '%-I:%M %p')) ELSE strftime(ts, '%b %-d, %Y') END AS shown FROM events")
def date_formats(spark, sf_dir):
    """TXT-41."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", formats.shown_date(ms, F.lit("2024-01-01").cast("date")).alias("shown"))


@query("page_jumps", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size BETWEEN 1 AND 30 THEN p_size END::INT AS page FROM part")
def page_jumps(spark, sf_dir):
    """TXT-42."""
    typed = F.expr("case p_partkey % 3 when 0 then concat(' ', p_size, ' ') when 1 then concat('p', p_size) else '0' end")
    return table(spark, sf_dir, "part").select("p_partkey", validate.page_jump(typed, F.lit(30)).alias("page"))


@query("colours", "SELECT p_partkey, '#' || printf('%06x', (p_partkey * 7919 % 16777216)::BIGINT) AS hex, CASE WHEN p_partkey % 256 = 0 THEN 1.0 ELSE (p_partkey % 256) / 255.0 END::DOUBLE AS opacity FROM part")
def colours(spark, sf_dir):
    """TXT-43: decodes and encodes again."""
    text = F.expr("concat('#', lpad(hex(p_partkey * 7919 % 16777216), 6, '0'))")
    rows = table(spark, sf_dir, "part", "p_partkey").withColumn("c", formats.colour_channels(text))
    return rows.select("p_partkey", formats.colour_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("hex"), formats.opacity((F.col("p_partkey") % 256).cast("double")).alias("opacity"))


@query("render_addresses", "SELECT p_partkey, 'pdfr://localhost/render?doc=' || p_partkey || '&src=' || p_size || '&rot=' || (p_partkey % 5 * 90) || '&scale=1500&gen=1&kind=tile' AS address, CASE WHEN p_partkey % 5 < 4 THEN p_partkey END::BIGINT AS doc, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 * 90 END::BIGINT AS rot, CASE WHEN p_partkey % 5 < 4 THEN 'tile' END AS kind FROM part")
def render_addresses(spark, sf_dir):
    """TXT-45: a rotation of 360 is refused."""
    rot = F.col("p_partkey") % 5 * 90
    rows = table(spark, sf_dir, "part").withColumn("address", formats.render_address(F.col("p_partkey"), F.col("p_size"), rot, F.lit(1500), F.lit(1), F.lit("tile")))
    rows = rows.withColumn("f", formats.render_fields(F.col("address")))
    return rows.select("p_partkey", "address", "f.doc", "f.rot", "f.kind")


@query("utf16_texts", "SELECT p_partkey, p_name AS text FROM part")
def utf16_texts(spark, sf_dir):
    """TXT-46."""
    data = F.encode(F.concat(F.col("p_name"), F.lit("\x00junk")), "UTF-16LE")
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", formats.utf16_text(data).alias("text"))


@query("shortcuts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Ctrl+Shift+' ELSE 'Alt+PgDn+' END || upper(chr((97 + p_partkey % 26)::INT)) AS shown FROM part")
def shortcuts(spark, sf_dir):
    """TXT-47."""
    spec = F.expr("concat(case p_partkey % 2 when 0 then 'mod+shift+' else 'alt+pagedown+' end, char(97 + p_partkey % 26))")
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", formats.shortcut(spec).alias("shown"))
