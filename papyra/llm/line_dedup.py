"""Line dedup: levelled sorted runs of line hashes, compacted as they pile up.

A run holds hashes with the number of documents and the largest document seen with them. Each batch of lines is
merge-anti-joined with the runs: hashes that no run has become the batch's own sorted run, so that every hash lives in
one run; hashes that some run has only add to a tally. When a level has `fanout` runs they are merged into one run of
the next level, so n batches leave O(fanout * log n) runs to join with.

All work is on DataFrame functions. A line that a third of all documents hold is counted with map-side partial sums,
and joined by a sort-merge join whose skewed partitions Spark splits. The lines of one document travel as one array of
positions, never as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import ASCII_SPACE, Scratch, ascii_lower, row_key

HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Array of keys, one for each line: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """The index: levels of sorted runs in the shared folder, and a tally of known hashes seen again."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.levels: list[list[str]] = [[]]
        self.tallies: list[str] = []
        self.made = 0

    def _put(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{self.made:06d}"
        self.made += 1
        self.scratch.write(rows, name)
        return name

    def _all(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.scratch.path}/{n}" for n in names)) if names else None

    def runs(self) -> DataFrame | None:
        return self._all([n for level in self.levels for n in level])

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of rows (h1, h2, __id); gives back the hashes that were new to the index."""
        keys = lines.select(*HASH, "__id").distinct().groupBy(*HASH).agg(F.count("*").alias("n"), F.max("__id").alias("top"))
        known = self.runs()
        if known is None:
            name = self._put(keys.sortWithinPartitions(*HASH), "run")
        else:
            keys = self.scratch.write(keys, f"batch-{self.made:06d}")
            known = known.select(*HASH).hint("merge")
            name = self._put(keys.join(known, HASH, "left_anti").sortWithinPartitions(*HASH), "run")
            self.tallies.append(self._put(keys.join(known, HASH, "left_semi"), "tally"))
        self.levels[0].append(name)
        self._compact()
        return self._all([name]) if name in self.levels[0] else self.runs()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._put(self._all(level).repartition(*HASH).sortWithinPartitions(*HASH), "run")
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(merged)
                for old in level:
                    self.scratch.drop(old)
                level.clear()

    def counts(self) -> DataFrame:
        """Rows (h1, h2, n, top) over all batches; n is exact if no document is in two batches."""
        parts = [x for x in (self.runs(), self._all(self.tallies)) if x is not None]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """Drops lines that min_docs or more documents share, except in the document of the largest doc_id.

    Gives rows (row, n_lines, n_dropped, kept): row is the struct of all input columns, kept the text that stays.
    Null or empty text is one empty line. A null doc_id counts as the smallest. Rows that repeat an id count once
    for a line and are judged alike. Keys of fewer than min_chars code points always stay. Columns may have any names.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), *row_key(F.col("doc_id"), text))
    lines = (
        rows.select("__id", "__t1", F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__t1", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.pmod(F.xxhash64("__id"), F.lit(batches)).cast("int").alias("batch"))
    )
    lines = scratch.write(lines, "lines", "batch")
    index = LineRuns(spark, scratch, fanout)
    for batch in range(batches):
        index.add(lines.where(F.col("batch") == batch))
    shared = index.counts().where(F.col("n") >= min_docs)
    shared = scratch.write(shared.select(*HASH, "top"), "shared")
    dropped = (
        lines.join(shared, HASH).where(F.col("__id") < F.col("top"))
        .groupBy("__id", "__t1").agg(F.collect_set("pos").alias("gone"))
    )
    parts = F.split(F.col("text"), "\n", -1)
    joined = rows.join(dropped, ["__id", "__t1"], "left").select("row", "text", "gone", F.size(parts).alias("n_lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        "row",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB's ltrim/rtrim with a set of characters, and translate for A-Z alone.
OP1_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), shared AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id < s.top, false) AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
