"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text is the weighted set of its five-word shingles: weight = count in the text * mean idf of the five words, with
idf = 1 + ln((N+1)/(df+1)) / ln(N+1), in [1, 2] at every corpus size. df counts all documents, by word; a shingle's own
df would make a group of copies look less alike the larger it is, and cost a shuffle of every shingle. Words share 2**18
counters by hash, so the table that tasks get is 1 MB at any size.

1. One pass samples every text: `samples` ICWS draws, banded by `band_rows`. Texts with equal weighted sets are one node.
2. Texts of a band bucket are compared with its centres, which verify by weighted Jaccard similarity on whole texts.
   A bucket of up to CENTRES + 1 texts is compared in full that way; a larger one in rounds: first with centres drawn by
   hash, then with those that proved to have most links; each round leaves out what is already in one class.
3. Larger buckets that still hold several classes are compared in full, in tiles of `tile` texts, by matrix products;
   a tile pair returns links of a spanning forest alone, never all pairs.
4. Classes are the connected components of verified links, named by their smallest document.

No step gathers a bucket in one task: buckets meet by joins whose skewed partitions Spark splits, and tiles are bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import KEPT, Scratch, freeing, heavy_join, row_key, set_up_shared, small_batches

WORD = re.compile(r"\w+")
SHINGLE = 5
BUCKETS = 18
CENTRES = 2
_golden = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word, kept for up to 2**19 words of a task."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()
KEPT.append(_hashes)


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_set(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingle hashes, how often each occurs and its mean idf. A text of fewer words than a shingle is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h, np.zeros(0), np.zeros(0)
    n = min(SHINGLE, len(h))
    at = len(h) - n + 1
    keys, own = np.zeros(at, dtype=np.uint64), idf[(h >> np.uint64(64 - BUCKETS)).astype(np.int64)]
    mean = np.zeros(at)
    for k in range(n):
        keys = keys * _golden + h[k : k + at]
        mean += own[k : k + at]
    keys, first, count = np.unique(mixed(keys), return_index=True, return_counts=True)
    return keys, count.astype(np.float64), mean[first] / n


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two weighted sets; 0 if either is empty."""
    total = (a[1] * a[2]).sum() + (b[1] * b[2]).sum()
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = (np.minimum(a[1][i], b[1][j]) * a[2][i]).sum()
    return float(least / (total - least))


class Sampler:
    """ICWS: for draw i and element k of weight S, r and c are Gamma(2, 1), b uniform, all from a hash of (i, k);
    t = floor(ln S / r + b), and the element of least ln c - r (t - b) - r is drawn, with its t."""

    def __init__(self, samples: int, band_rows: int):
        self.samples, self.band_rows = samples, band_rows
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 64.0)
        for _ in range(60):  # quantiles of Gamma(2, 1): 1 - (1 + x) exp(-x) = p
            mid = (low + high) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        self.gamma, self.log_gamma, self.uniform = low, np.log(low), p
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * _golden) | np.uint64(1)

    def bands(self, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
        log_w = np.log(weight)
        best, drawn = np.full(self.samples, np.inf), np.zeros(self.samples, dtype=np.uint64)
        for at in range(0, len(keys), 2048):
            k, w = keys[at : at + 2048], log_w[at : at + 2048]
            x = k[None, :] * self.seeds[:, None]
            x ^= x >> np.uint64(32)
            x *= _golden
            r = self.gamma[(x >> np.uint64(48)).astype(np.intp)]
            c = self.log_gamma[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
            b = self.uniform[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
            t = np.floor(w / r + b)
            a = c - r * (t - b) - r
            least = a.argmin(axis=1)
            row = np.arange(self.samples)
            better = a[row, least] < best
            best = np.where(better, a[row, least], best)
            drawn = np.where(better, mixed(k[least] + mixed(t[row, least].astype(np.int64).astype(np.uint64))), drawn)
        out = np.zeros(self.samples // self.band_rows, dtype=np.uint64)
        for k in range(self.band_rows):
            out = mixed(out * _golden + drawn[k :: self.band_rows])
        return out.view(np.int64)


def word_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (bucket, n): the documents of this partition that hold a word of the bucket."""
    df = np.zeros(1 << BUCKETS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            df[np.unique((word_hashes(text.as_py()) >> np.uint64(64 - BUCKETS)).astype(np.int64))] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf of each bucket, over all documents: 2**18 rows at most come back."""
    n = docs.count()
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(freeing(word_df), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << BUCKETS)
    df[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return 1 + np.log((n + 1) / (df + 1)) / np.log(n + 2)


def sampled(sent, samples: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(samples, band_rows), sent.value
        for batch in batches:
            sets, bands = [], []
            for text in batch.column(2):
                keys, count, mean = weighted_set(text.as_py(), idf)
                if len(keys):
                    sets.append(hashlib.blake2b(keys.tobytes() + count.tobytes(), digest_size=16).digest())
                    bands.append(sampler.bands(keys, count * mean))
                else:
                    sets.append(None)
                    bands.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["__id", "__t1", "set", "bands"])

    return run


def verified(sent, least: float):
    """Rows (a, text_a, b, text_b) to the links (a, b) whose similarity is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, last, left = sent.value, None, None
        for batch in batches:
            out = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, left = a, weighted_set(batch.column(1)[i].as_py(), idf)
                if similarity(left, weighted_set(batch.column(3)[i].as_py(), idf)) >= least:
                    out.append(i)
            yield batch.select([0, 2]).take(pa.array(out, pa.int64()))

    return run


def tile_links(sent, least: float):
    """Rows (tile, side, node, label, text), a tile pair's together: links of a spanning forest between its nodes of different labels."""

    def links(nodes: list, labels: list, texts: list) -> list[tuple]:
        idf = sent.value
        sets = [weighted_set(t, idf) for t in texts]
        sizes = np.array([(s[1] * s[2]).sum() for s in sets])
        parent = {x: x for x in labels}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        # an element that occurs n times is n columns of its idf, so that a product sums the minima
        keys = np.concatenate([np.repeat(s[0], s[1].astype(np.int64)) for s in sets])
        level = np.concatenate([np.concatenate([np.arange(int(c)) for c in s[1]]) if len(s[0]) else np.zeros(0) for s in sets])
        weight = np.concatenate([np.repeat(s[2], s[1].astype(np.int64)) for s in sets])
        row = np.repeat(np.arange(len(sets)), [int(s[1].sum()) for s in sets])
        _, column, times = np.unique(mixed(keys + mixed(level.astype(np.uint64))), return_inverse=True, return_counts=True)
        shared = times[column] > 1  # a column of one text adds to no pair
        order = np.flatnonzero(shared)[np.argsort(column[shared], kind="stable")]
        slot = np.cumsum(np.concatenate([[False], column[order][1:] != column[order][:-1]]))
        root_of = np.sqrt(weight[order])
        common = np.zeros((len(sets), len(sets)))
        bounds = np.searchsorted(slot, np.arange(0, (int(slot[-1]) if len(slot) else -1) + 4097, 4096))
        for at, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            dense = np.zeros((len(sets), 4096), dtype=np.float64)
            dense[row[order[lo:hi]], slot[lo:hi] - 4096 * at] = root_of[lo:hi]
            common += dense @ dense.T
        common[np.diag_indices(len(sets))] = sizes
        sim = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1e-300)
        for i, j in zip(*np.nonzero(np.triu(sim >= least - 1e-9, 1)), strict=True):
            a, b = root(labels[i]), root(labels[j])
            if a != b and similarity(sets[i], sets[j]) >= least:
                parent[a] = b
                found.append((nodes[i], nodes[j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def out():
            rows = links(*held) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            for tile, node, label, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if tile != key:
                    yield out()
                    key, held = tile, ([], [], [])
                if node not in held[0][-1:]:
                    held[0].append(node)
                    held[1].append(label)
                    held[2].append(text)
        yield out()

    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, label): the least node that links reach. Every round takes the least label of neighbours, then that label's
    label, so chains halve; rounds go on until no label changes, and each is written to the shared folder."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label"))
    labels = scratch.write(labels, f"{name}-0")
    for turn in count(1):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = new.join(jump, "low", "left").select("node", F.coalesce("far", "low").alias("label"), "old")
        new = scratch.write(new, f"{name}-{turn}")
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
        if turn > 1:
            scratch.drop(f"{name}-{turn - 2}")


def near_duplicates(docs: DataFrame, least: float = 0.8, samples: int = 24, band_rows: int = 3, tile: int = 192) -> DataFrame:
    """Classes of near-duplicate rows: (__id, __t1, class_id, class_t1), a row for each row of docs, repeats included.

    class_id and class_t1 are the smallest (__id, __t1) of the class, which tell it from others where ids are null or
    repeat. Null texts and texts without words are in the class of the rows that have their id and text, empty text for
    null. A null id counts as the least long. Columns may have any names; doc_id and text alone are read. An empty table
    gives no rows. A pair of similarity s shares no band with probability (1 - s**band_rows)**(samples / band_rows), 0.0032
    at 0.8 and 0.0000014 at 0.9, and is then linked only through third texts.
    """
    spark = docs.sparkSession
    set_up_shared(spark)
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(*row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(idf_table(docs))
    sets = docs.mapInArrow(freeing(sampled(sent, samples, band_rows)), "__id long, __t1 long, set binary, bands array<long>")
    sets = scratch.write(sets, "sets")
    # a node is a weighted set, named by the row that holds it first
    own = F.struct("__id", "__t1")
    nodes = sets.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(own).alias("own"), F.min_by("bands", own).alias("bands"))
    # numbered as they are written, so that two sets are never one node; their hash draws centres
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "own.*", "bands"), "nodes")
    rows = nodes.select("node", F.xxhash64(F.lit(3), "set").alias("h"), F.posexplode("bands").alias("band", "key"))
    drawn = F.struct("h", "node")
    full = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(drawn).alias("c1"), F.max(drawn).alias("c2")).where(F.col("n") > 1)
    members = rows.join(full, ["band", "key"]).select("band", "key", "n", "node", F.array("c1.node", "c2.node").alias("centres"))
    members = scratch.write(members, "members")
    asked = members.select("node").distinct().join(nodes.select("node", "__id", "__t1"), "node")
    texts = docs.join(asked, ["__id", "__t1"]).dropDuplicates(["node"]).select("node", "text")
    texts = scratch.write(texts, "texts")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """Verifies pairs (a, b), each once, a being the centre: its set is kept from row to row."""
        pairs = pairs.distinct()
        pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        pairs = pairs.select("a", "text_a", "b", "text_b").sortWithinPartitions("a")
        return scratch.write(pairs.mapInArrow(freeing(verified(sent, least)), "a long, b long"), name)

    def toward(df: DataFrame) -> DataFrame:
        pairs = df.select(F.explode("centres").alias("a"), F.col("node").alias("b"))
        return pairs.where(F.col("a") != F.col("b")).select(F.when(F.xxhash64("a") < F.xxhash64("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("p")).select("p.*")

    links = compare(toward(members), "links-1")
    labels = components(links, scratch, "round-1")
    large = members.where(F.col("n") > CENTRES + 1).select("band", "key", "node")
    for turn in (2, 3):
        left = unsettled(large, labels)
        hubs = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        left = left.join(hubs, "node", "left")
        rank = F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "label")
        best = left.groupBy("band", "key").agg(F.max(rank).alias("c"))
        pairs = left.join(best, ["band", "key"]).where(F.col("label") != F.col("c.label")).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        more = compare(pairs, f"links-{turn}")
        links = scratch.write(links.union(more), f"all-links-{turn}")
        labels = components(links, scratch, f"round-{turn}")
    left = scratch.write(unsettled(large, labels), "left")
    sizes = left.groupBy("band", "key").agg(F.ceil(F.count("*") / (tile // 2)).cast("int").alias("tiles"))
    spread = left.join(sizes, ["band", "key"]).withColumn("at", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spread = spread.select("band", "key", "node", "label", "at", other)
    spread = spread.select(F.xxhash64("band", "key", F.least("at", "other"), F.greatest("at", "other")).alias("tile"), "node", "label").distinct()
    spread = spread.join(texts, "node").select("tile", "node", "label", "text")
    spread = spread.repartition("tile").sortWithinPartitions("tile", "node")
    more = scratch.write(spread.mapInArrow(freeing(tile_links(sent, least)), "a long, b long"), "links-4")
    labels = components(links.union(more), scratch, "round-4")
    joined = nodes.select("node", "set", "__id", "__t1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = joined.groupBy("label").agg(F.min(F.struct("__id", "__t1")).alias("least"))
    named = joined.join(least_id, "label").select("set", F.col("least.__id").alias("class_id"), F.col("least.__t1").alias("class_t1"))
    named = scratch.write(named, "named")
    out = heavy_join(sets.select("__id", "__t1", "set"), named, ["set"])  # a third of all rows may share a set
    return out.select("__id", "__t1", F.coalesce("class_id", "__id").alias("class_id"), F.coalesce("class_t1", "__t1").alias("class_t1"))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes have more than one label: (band, key, node, label)."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key")
    return named.join(several, ["band", "key"]).select("band", "key", "node", "label")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    null_id = F.lit(-(2**63))
    return found.select(F.nullif("__id", null_id).alias("doc_id"), F.nullif("class_id", null_id).alias("class_id"))
