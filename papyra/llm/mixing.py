"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source are dealt into shards of about `shard_words` words, in a seeded order of documents, and each shard
is cut into blocks of `block` words. The blocks that a mix needs are seats: the highest quotients target/(2k+1) give each
source its whole number of blocks, and the same rule over a source's shards gives each shard its quota. A shard takes
every block quota // blocks times, and a run of quota % blocks more from a seeded start, round the end; as the order of
documents is a seeded shuffle, the run is a random sample that cuts two documents at most.

No step has a row for each block or quotient: seats are first rounded, and only the few that rounding gave too many or
too few are settled by ranked quotients. Rows per window: one shard's documents, one source's shards, or the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.llm.common import Scratch, row_key, set_up_shared, small_or_merge

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, tie: list[str], name: str) -> DataFrame:
    """Adds column `name`: the seats of each row when its group's `seats` go to the highest quotients votes/(2k+1).

    Rounding votes * seats / total gives all but d seats of a group of n rows, and settling those changes a row by no
    more than votes * (|d| + n) / total + 1. So that many quotients of each row are ranked, O(n) in all, and the
    result is that of ranking them all. Ties go to the first row by `tie`. A group without votes gets no seats.
    """
    all_of = W.partitionBy(*group)
    total, n = F.sum(votes).over(all_of), F.count("*").over(all_of)
    ideal = F.when(total > 0, F.col(votes) * F.col(seats) / total).otherwise(0.0)
    df = df.withColumn("__s", F.floor(ideal + 0.5).cast("long")).withColumn("__total", total).withColumn("__n", n)
    df = df.withColumn("__d", F.when(F.col("__total") > 0, F.col(seats) - F.sum("__s").over(all_of)).otherwise(F.lit(0)).cast("long"))
    most = F.floor(F.when(F.col("__total") > 0, F.col(votes) * (F.abs("__d") + F.col("__n")) / F.col("__total")).otherwise(0.0)).cast("long") + 2
    steps = F.when(F.col("__d") == 0, F.lit(1)).when(F.col("__d") < 0, F.greatest(F.lit(1), F.least(most, F.col("__s")))).otherwise(most)
    given = [c for c in df.columns if not c.startswith("__")]
    steps = df.withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), steps)))
    odd = F.when(F.col("__d") > 0, 2 * (F.col("__s") + F.col("__j")) - 1).otherwise(2 * (F.col("__s") - F.col("__j") + 1) - 1)
    steps = steps.withColumn("__q", F.when(odd > 0, F.col(votes) / odd))
    rank = W.partitionBy(*group).orderBy(F.when(F.col("__d") > 0, -F.col("__q")).otherwise(F.col("__q")).asc_nulls_last(), *tie, "__j")
    picked = F.row_number().over(rank) <= F.abs("__d")
    steps = steps.withColumn("__more", F.when(picked & F.col("__q").isNotNull(), F.signum("__d")).otherwise(0).cast("long"))
    return steps.groupBy(*given).agg((F.first("__s") + F.sum("__more")).alias(name))


def source_targets(sizes: DataFrame, weights: tuple, share: float, most_repeats: int) -> DataFrame:
    """Rows (source, source_size, target, rank): weights by rank of code points, null last; no target above most_repeats sizes.

    The rule of resharing what caps cut off has one fixed point: sources are filled in order of cap/weight, and the first
    that its fair part of the rest doesn't fill ends this. That is one running sum over the sources.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("rank", rank.cast("long"))
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(most_repeats))
    order = W.orderBy(F.col("cap") / F.col("w"), "rank")
    every = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest_w = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) * share - before) / rest_w
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    water = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(every)
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * water)).select("source", "source_size", "target", "rank")


def mix_sources(
    docs: DataFrame,
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    most_repeats: int = 2,
    block: int = 16,
    shard_words: int = 2**18,
    seed: int = 17,
    keep_rows: bool = True,
) -> DataFrame:
    """Judges each document: rows (row, doc_id, size, source_size, target, copies, parts, taken).

    copies is how often the mix takes all of it, parts the word ranges [from, to) it takes once more; taken counts the
    words of both. keep_rows=False leaves out row, the struct of all input columns. Null text has no words; null source
    is a source, the last. Rows that repeat count each. Sources without words have target 0. Reruns agree, however the
    input is partitioned, as order and starts come from hashes of the seed, ids and texts. Where rows agree in id and text,
    which of them takes more words is free. A shard whose quota is above most_repeats times its blocks gives up what is
    above: a quota is at most its part of the source's target, rounded, so that is one block a shard, of the last words.
    Texts are counted once, for a table without texts; with keep_rows, once more for the rows that come out.
    """
    set_up_shared(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col("doc_id"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *row_key(F.col("doc_id"), text)]
    counted = scratch.write(docs.select(*own), "sizes")
    sized = docs.select(F.struct("*").alias("row"), *own) if keep_rows else counted
    sources = source_targets(counted.select("source", "size"), weights, share, most_repeats).checkpoint()
    n_sources = sources.count()
    seats = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    quotas = sainte_lague(sources.withColumn("seats", seats), [], "target", "seats", ["rank"], "quota").drop("seats")
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).checkpoint()
    shard = F.pmod(F.xxhash64(F.lit(seed), "__id", "__t1"), F.col("shards"))


    def place(rows: DataFrame) -> DataFrame:
        joined = rows.alias("d").join(small_or_merge(quotas.alias("s"), n_sources), F.col("d.source").eqNullSafe(F.col("s.source")))
        return joined.select("d.*", "s.rank", "s.source_size", "s.target", "s.quota", shard.alias("shard"))

    placed = place(sized)
    dealt = place(counted).groupBy("rank", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    dealt = sainte_lague(dealt, ["rank"], "shard_size", "quota", ["shard"], "seats")
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    dealt = dealt.select(
        "rank", "shard", "shard_size", blocks.alias("blocks"),
        F.least(F.col("seats"), most_repeats * blocks).alias("seats"),
        F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), blocks)).otherwise(0).alias("first"),
    )
    order = W.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "__id", "__t1"), "__id", "__t1", "size")
    rows = placed.drop("quota").withColumn("at", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    rows = rows.join(dealt, ["rank", "shard"])
    copies = F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("extra", F.col("seats") - F.col("copies") * F.col("blocks"))
    last = F.col("first") + F.col("extra")
    reach = lambda a, b: F.struct(
        F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), a * block - F.col("at"))).alias("from"),
        F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), b * block - F.col("at"))).alias("to"),
    )
    parts = F.array(reach(F.lit(0).cast("long"), last - F.col("blocks")), reach(F.col("first"), F.least(last, F.col("blocks"))))
    rows = rows.withColumn("parts", F.filter(parts, lambda p: p["to"] > p["from"]))
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"])
    kept = ["row"] if keep_rows else []
    return rows.withColumn("taken", F.col("copies") * F.col("size") + more).select(*kept, "doc_id", "size", "source_size", "target", "copies", "parts", "taken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep_rows=False).select("doc_id", "size", "source_size", "target", "taken")
