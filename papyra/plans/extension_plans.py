"""Plug-ins at work: resolvers in turn, and commands that a context offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import extensions
from papyra.registry import query, table


@query("resolvers_in_turn", """SELECT c_custkey, CASE WHEN k % 4 = 0 THEN '/first/' || (k % 60) WHEN k % 3 = 0 THEN '/second/' || (k % 60) END AS path FROM (SELECT c_custkey, c_custkey % 60 AS k FROM customer)""")
def resolvers_in_turn(spark, sf_dir):
    """UDF-02: the first resolver that knows an identifier answers."""
    k = F.col("value").cast("int")
    first = lambda ids: ids.where(k % 4 == 0).withColumn("path", F.concat(F.lit("/first/"), "value"))
    second = lambda ids: ids.where(k % 3 == 0).withColumn("path", F.concat(F.lit("/second/"), "value"))
    cited = table(spark, sf_dir, "customer").select("c_custkey", F.lit("n").alias("scheme"), (F.col("c_custkey") % 60).cast("string").alias("value"))
    return extensions.resolved_by(cited, [first, second]).select("c_custkey", "path")


@query("commands_offered", """WITH c AS (SELECT s_suppkey AS owner, CASE s_suppkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['document', 'pages'] ELSE ['document', 'pages', 'unsaved', 'history', 'tabs', 'library'] END AS facts FROM supplier),
    k AS (SELECT unnest(['file.open', 'file.save', 'edit.undo', 'page.delete', 'tabs.next', 'search.library']) AS key, unnest([[], ['document', 'unsaved'], ['document', 'history'], ['document', 'pages'], ['tabs'], ['library']]) AS needs)
    SELECT owner, key, len(list_filter(needs, lambda n: NOT list_contains(facts, n))) = 0 AS enabled, list_filter(needs, lambda n: NOT list_contains(facts, n))[1] AS reason FROM c, k""")
def commands_offered(spark, sf_dir):
    """UDF-04: what can run where, and what is missing where it can't."""
    k = F.col("s_suppkey")
    some = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    facts = F.when(k % 3 == 0, some()).when(k % 3 == 1, some("document", "pages")).otherwise(some("document", "pages", "unsaved", "history", "tabs", "library"))
    contexts = table(spark, sf_dir, "supplier").select(k.alias("owner"), facts.alias("facts"))
    return extensions.standard_commands().offered(contexts).select("owner", "key", "enabled", "reason")


@query("files_scanned", "SELECT 'docs/' || (s_suppkey % 3) || '/' || s_suppkey || '.' || CASE WHEN s_suppkey % 2 = 0 THEN 'pdf' ELSE 'PDF' END AS path, (10 + s_suppkey % 5)::BIGINT AS size FROM supplier")
def files_scanned(spark, sf_dir):
    """SRC-01, SRC-02: files written to nested folders, one a supplier of the table, found once each below roots of which one is in another."""
    import os
    import tempfile

    from papyra.sources import catalog

    root = tempfile.mkdtemp(prefix="papyra-scan-")  # the scan of the driver's own disk
    for (k,) in table(spark, sf_dir, "supplier", "s_suppkey").collect():
        folder = os.path.join(root, "docs", str(k % 3))
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{k}.{'pdf' if k % 2 == 0 else 'PDF'}"), "wb") as f:
            f.write(b"x" * (10 + k % 5))
        open(os.path.join(folder, f"{k}.txt"), "wb").close()
    os.symlink(os.path.join(root, "docs"), os.path.join(root, "linked"))
    rows = catalog.scanned_files(spark, [root, os.path.join(root, "docs"), os.path.join(root, "none")])
    return rows.select(F.substring("path", len(os.path.realpath(root)) + 2, 1000).alias("path"), "size")
