"""What is kept on disk, written and read back: sidecars, index, catalog, exports and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import formats, validate
from papyra.functions import text as tx
from papyra.plans.library_plans import FILE_SQL, files
from papyra.plans.search_plans import PATH
from papyra.plans.text_plans import NORM_SQL, pages
from papyra.registry import query, table
from papyra.sources import catalog, store

FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(strlen({p})), lambda i: ord(substr({p}, i + 1, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query("sidecar_names", f"SELECT path, lpad(lower(to_hex({FNV_SQL.format(p='path')}::UBIGINT)), 16, '0') AS name FROM (SELECT {FILE_SQL} FROM orders)")
def sidecar_names(spark, sf_dir):
    """SNK-02: FNV-1a of a path's bytes, here ASCII."""
    return files(spark, sf_dir).select("path", store.sidecar_name(F.col("path")).alias("name"))


TURN_SQL = "(({x}::UHUGEINT << {n}) % 18446744073709551616::UHUGEINT) + ({x}::UHUGEINT >> {m})"


@query("library_signature", f"""WITH f AS (SELECT {FILE_SQL} FROM orders), h AS (SELECT xor(xor({FNV_SQL.format(p='path')}, {TURN_SQL.format(x='mtime_ms', n=17, m=47)}), {TURN_SQL.format(x='size', n=31, m=33)}) AS h FROM f)
    SELECT (sum(h) % 18446744073709551616::HUGEINT)::VARCHAR AS signature FROM (SELECT h::HUGEINT AS h FROM h)""")
def library_signature(spark, sf_dir):
    """SCH-06: the same in whatever order the files come."""
    return store.signature(files(spark, sf_dir)).select(F.col("signature").cast("string").alias("signature"))


@query("index_is_usable", "SELECT true AS same, false AS changed, false AS absent")
def index_is_usable(spark, sf_dir):
    """SNK-09, STR-14: an index counts only for the files it was built of; else search goes over all documents."""
    root, now = store.folder(spark, "index"), files(spark, sf_dir)
    absent = store.usable(now, root)
    store.save_signature(now, root)
    other = now.withColumn("size", F.col("size") + F.when(F.col("path") == "/lib/r1/1.pdf", 1).otherwise(0))
    return spark.range(1).select(F.lit(store.usable(now.orderBy("size"), root)).alias("same"), F.lit(store.usable(other, root)).alias("changed"), F.lit(absent).alias("absent"))


def document_files(spark, sf_dir, *columns):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(PATH).alias("path"), (F.col("doc_id") * 1000).alias("mtime_ms"), (F.col("doc_id") + 7).alias("size"), *columns)


def document_pages(spark, sf_dir):
    """Pages with their document's file: both come of one row, so nothing is joined."""
    rows = document_files(spark, sf_dir, F.posexplode(F.split("text", "\n", -1)).alias("src", "raw"))
    return tx.with_search_text(rows, breaks=True)


DOC_PAGES_SQL = f"""SELECT doc_id, '/lib/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.pdf' AS path, src, raw, {NORM_SQL} AS norm FROM (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS src, unnest(string_split(text, chr(10))) AS raw FROM documents)"""


@query("sidecars_read_back", f"""SELECT path, src::INT AS src, norm || CASE WHEN doc_id % 10 = 2 THEN '!' ELSE '' END AS text, lower(norm) AS folded, length(raw)::INT AS char_count FROM ({DOC_PAGES_SQL}) WHERE doc_id % 10 NOT IN (3, 4)""")
def sidecars_read_back(spark, sf_dir):
    """SNK-01, SNK-05, SNK-06: pages are stored, some documents again with other text, some deleted; a document whose file has changed since is not indexed."""
    root, rows = store.folder(spark, "sidecars"), document_pages(spark, sf_dir)
    store.write_sidecars(rows, root)
    store.write_sidecars(rows.where("doc_id % 10 = 2").withColumn("normalized", F.concat("normalized", F.lit("!"))), root)
    docs = document_files(spark, sf_dir).distinct()
    store.delete_sidecars(docs.where("doc_id % 10 = 3"), root)
    now = docs.withColumn("size", F.col("size") + F.when(F.col("doc_id") % 10 == 4, 1).otherwise(0))
    return store.read_sidecars(now, root).select("path", "src", "text", "folded", "char_count")


@query("scan_copies", f"SELECT path, sha256(string_agg(lower(norm), chr(10) ORDER BY src)) AS sha, count(*)::INT AS lines FROM ({DOC_PAGES_SQL}) GROUP BY path")
def scan_copies(spark, sf_dir):
    """SNK-03."""
    rows = store.scan_copies(document_pages(spark, sf_dir))
    return rows.select("path", F.sha2("text", 256).alias("sha"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))


@query("catalog_read_back", f"SELECT path, size, row_number() OVER (ORDER BY path)::INT AS place FROM (SELECT o_orderkey AS k, {FILE_SQL} FROM orders) WHERE k % 6 <> 1")
def catalog_read_back(spark, sf_dir):
    """SNK-10, SRC-12, ORD-05: a catalog is stored by path, read, and freed of entries whose file is gone or has changed."""
    from pyspark.sql import Window as W

    root, every = store.folder(spark, "catalog"), files(spark, sf_dir)
    store.save_catalog(every.select("path", "mtime_ms", "size"), root)
    now = every.withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 12 == 1, 1).otherwise(0)).where("o_orderkey % 12 <> 7")
    rows = store.load_catalog(spark, root, now, "path string, mtime_ms long, size long")
    return rows.select("path", "size", F.row_number().over(W.orderBy("path")).alias("place"))


@query("tables_replaced", "SELECT s_suppkey, s_name || '-new' AS name FROM supplier")
def tables_replaced(spark, sf_dir):
    """SNK-11: a table takes another's place only once it is read back; one that fails the test leaves it."""
    root, rows = store.folder(spark, "replaced"), table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("-new")).alias("name"))
    rows.limit(0).write.parquet(root)
    n = rows.count()
    store.replace_verified(rows, root, lambda written: written.count() == n)
    try:
        store.replace_verified(rows.limit(1), root, lambda written: written.count() == n)
    except ValueError:
        pass
    return spark.read.parquet(root)


@query("notes_exported", """WITH e AS (SELECT c_nationkey AS doc, c_custkey AS "at", (c_custkey % 6)::INT AS page, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'one' || chr(10) || 'two' ELSE c_name END AS quote, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'note ' || c_custkey END AS note FROM customer),
    s AS (SELECT doc, "at", page, concat_ws(chr(10) || chr(10), CASE WHEN quote <> '' THEN regexp_replace(quote, '(?m)^', '> ', 'g') END, CASE WHEN note <> '' THEN note END) AS body FROM e WHERE quote <> '' OR note <> '')
    SELECT doc, sha256('# Notes on ' || doc || chr(10) || chr(10) || string_agg('**Page ' || (page + 1) || '**' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page, "at") || chr(10)) AS sha FROM s GROUP BY doc""")
def notes_exported(spark, sf_dir):
    """SNK-13: a document's notes as Markdown, by page."""
    k = F.col("c_custkey")
    quote = F.when(k % 4 == 0, "").when(k % 4 == 1, "one\ntwo").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), k.alias("at"), (k % 6).cast("int").alias("page"), quote.alias("quote"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("note "), k)).alias("note"))
    out = formats.markdown_notes(rows, "doc", F.concat(F.lit("Notes on "), "doc"))
    return out.select("doc", F.sha2("markdown", 256).alias("sha"))


@query("bench_reports", """SELECT event_type, '{"schemaVersion":1,"category":"' || event_type || '"' || CASE WHEN count(*) FILTER (value > 10) > 0 THEN ',"slow":' || count(*) FILTER (value > 10) ELSE '' END || CASE WHEN event_type = 'error' THEN ',"errors":' || count(*) ELSE '' END || '}' AS report FROM events GROUP BY event_type""")
def bench_reports(spark, sf_dir):
    """SNK-14: metrics that were not measured are left out."""
    slow = F.count_if(F.col("value") > 10)
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.when(slow > 0, slow).alias("slow"), F.when(F.col("event_type") == "error", F.count("*")).alias("errors"))
    report = F.struct(F.lit(1).alias("schemaVersion"), F.col("event_type").alias("category"), "slow", "errors")
    return rows.select("event_type", F.to_json(report, {"ignoreNullFields": "true"}).alias("report"))


@query("corpus_discovered", """WITH f AS (SELECT '/c/' || p_brand || '/' || p_name || ' ' || p_partkey || '.PDF' AS path, lower(p_name || ' ' || p_partkey || '.PDF') AS name FROM part),
    c AS (SELECT path, CASE WHEN contains(name, 'widget') THEN 'widget' WHEN contains(name, 'ring') THEN 'ring' WHEN contains(name, 'red') THEN 'red' END AS category FROM f) SELECT category, min(path) AS path, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category""")
def corpus_discovered(spark, sf_dir):
    """SRC-21: the first category whose token a file's name has, and its first file by path."""
    file = F.concat("p_name", F.lit(" "), "p_partkey", F.lit(".PDF"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/c/"), "p_brand", F.lit("/"), file).alias("path"))
    return catalog.first_of_category(rows, ["widget", "ring", "red"])


@query("print_files", """SELECT s_suppkey, s_suppkey % 4 = 0 AS ours, s_suppkey % 4 = 0 AND s_suppkey % 3 = 1 AS swept FROM supplier""")
def print_files(spark, sf_dir):
    """SNK-15: files of print jobs by name and folder, and those older than an hour."""
    k = F.col("s_suppkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/tmp/papyra-print-"), k, F.lit(".pdf"))).when(k % 4 == 1, "/tmp/x/papyra-print-1.pdf").when(k % 4 == 2, "/tmp/papyra-print-1.txt").otherwise("/tmp/other.pdf")
    ours = validate.is_print_file(path, F.lit("/tmp"))
    return table(spark, sf_dir, "supplier", "s_suppkey").select(k, ours.alias("ours"), (ours & (k % 3 * 3_600_001 > 3_600_000) & (k % 3 == 1)).alias("swept"))


@query("scanned_metadata", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'arxiv' ELSE 'doi' END AS scheme, CASE doc_id % 3 WHEN 0 THEN '2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') ELSE '10.1234/ab' || doc_id END AS value FROM documents""")
def scanned_metadata(spark, sf_dir):
    """SRC-11: a file's name decides; only without an identifier there its first page is read."""
    from papyra.functions import citations

    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("arXiv-2401."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2.pdf"))).otherwise(F.concat(F.lit("paper "), k, F.lit(".pdf")))
    page = F.concat(F.lit("A title that is long enough\ndoi:10.1234/AB"), k, F.lit(". text"))
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", citations.scanned(name, page).alias("c")).select("doc_id", "c.scheme", "c.value")


@query("extracted_pages", r"""SELECT doc_id, count(*) FILTER (regexp_replace(raw, '[\x09-\x0D\x20]', '', 'g') <> '')::BIGINT AS pages, sum(length(raw)) FILTER (regexp_replace(raw, '[\x09-\x0D\x20]', '', 'g') <> '')::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents) GROUP BY doc_id HAVING count(*) FILTER (regexp_replace(raw, '[\x09-\x0D\x20]', '', 'g') <> '') > 0""")
def extracted_pages(spark, sf_dir):
    """SRC-10: pages that are more than white space; a document without any is none."""
    rows = pages(spark, sf_dir).where(~F.coalesce(F.col("raw"), F.lit("")).rlike(rf"\A[{tx.WHITE}]*\z"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.char_length("raw")).alias("chars"))


@query("library_roots_missing", "SELECT s_suppkey, ['/a/' || s_suppkey] AS missing FROM supplier")
def library_roots_missing(spark, sf_dir):
    """JON-18: roots of the settings that the engine has not got."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier", "s_suppkey").select(k, F.array_except(F.array(F.concat(F.lit("/a/"), k), F.lit("/b"), F.lit("/b")), F.array(F.lit("/b"), F.lit("/c"))).alias("missing"))


@query("index_files", """WITH d AS (SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS slot, encode(lower(n_name)) AS b FROM nation), g AS (SELECT DISTINCT region, slot, hex(b[i:i + 3]) AS gram FROM (SELECT region, slot, b, unnest(range(1, octet_length(b) - 2)) AS i FROM d))
    SELECT region, gram, list_sort(list(slot::BIGINT)) AS slots FROM g GROUP BY ALL""")
def index_files(spark, sf_dir):
    """SNK-07, SNK-08: the index of a region's nations as the bytes of a file, and what reading them gives. A file is of few documents."""
    import pandas as pd

    from papyra.operators.search import grams_of

    def through(group: pd.DataFrame) -> pd.DataFrame:
        names = group.sort_values("n_nationkey").n_name.str.lower().tolist()
        postings: dict = {}
        for slot, name in enumerate(names):
            for gram in grams_of(name):
                postings.setdefault(gram, []).append(slot)
        data = store.index_bytes(7, names, postings, [])
        if store.index_of_bytes(data[:-1]) is not None:
            raise ValueError("a cut file is no index")
        _, _, lists, _ = store.index_of_bytes(data)
        return pd.DataFrame([(int(group.n_regionkey.iloc[0]), f"{g:08X}", x) for g, x in lists.items()], columns=["region", "gram", "slots"])

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(through, "region int, gram string, slots array<long>")
