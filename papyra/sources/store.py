"""What the library keeps on disk: sidecars of folded pages, the gram index, the catalog; and replacing files safely.

Tables are Parquet below one folder, in buckets by hash of the path, so that a document's rows are found and replaced without
reading others. The gram index also has a byte format for a single file.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.operators import search

SIDECAR_VERSION, BUCKETS = 1, 64
#: FNV-1a, and the head of a gram index file (magic, version) with its mark of a dropped gram.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MAGIC, VERSION, DROPPED = 0x49475053, 1, 0xFFFFFFFF
WIDE = 1 << 64


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir, or a temporary one if the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="papyra-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fnv(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME % WIDE
    return h


def sidecar_name(path: Column) -> Column:
    """16 hex digits by FNV-1a of the path's bytes."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else f"{fnv(p.encode()):016x}")

    return run(path)


def file_mark(path: Column, mtime_ms: Column, size: Column) -> Column:
    """What a file adds to its library's signature, as a decimal: equal for equal path, time and size."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, times: pd.Series, sizes: pd.Series) -> pd.Series:
        turn = lambda x, n: ((x << n) | (x >> (64 - n))) % WIDE
        return pd.Series([str(fnv(p.encode()) ^ turn(int(t) % WIDE, 17) ^ turn(int(s) % WIDE, 31)) for p, t, s in zip(paths, times, sizes, strict=True)])

    return run(path, mtime_ms, size).cast("decimal(20,0)")


def signature(files: DataFrame) -> DataFrame:
    """One row, the signature of files (path, mtime_ms, size) in any order: their marks added up, modulo 2**64."""
    total = F.coalesce(F.sum(file_mark(F.col("path"), F.col("mtime_ms"), F.col("size"))), F.lit(0)).cast("decimal(38,0)")
    return files.agg((total % F.lit(str(WIDE)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("signature"))


def write_sidecars(pages: DataFrame, root: str) -> None:
    """Stores pages (path, mtime_ms, size, src, raw, normalized, folded, breaks), replacing what documents of these paths had.

    Only buckets that the paths fall in are rewritten; a bucket's other documents are carried over.
    """
    rows = pages.select("path", "mtime_ms", "size", "src", F.col("normalized").alias("text"), "folded", "breaks", F.char_length("raw").alias("char_count"), F.lit(SIDECAR_VERSION).alias("version"), bucket(F.col("path")))
    if exists(pages.sparkSession, root):
        replace_buckets(rows, root, buckets_of(rows))
    else:
        rows.repartition("bucket").sortWithinPartitions("bucket", "path", "src").write.option("compression", "zstd").partitionBy("bucket").parquet(root)


def buckets_of(rows: DataFrame) -> list[int]:
    return [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most


def replace_buckets(rows: DataFrame, root: str, buckets: list[int]) -> None:
    """Puts rows in the place of what their paths had in these buckets; a row without a version only takes its path's away.

    Texts are moved once, by bucket, and written once: new and stored rows meet there in order of path, the new first, and
    what is written takes the buckets' places by renaming.
    """
    spark, staged = rows.sparkSession, f"{root}.{uuid.uuid4().hex}"
    old = spark.read.parquet(root).where(F.col("bucket").isin(buckets))
    every = rows.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    first = F.first("__new").over(W.partitionBy("bucket", "path").orderBy(F.desc("__new"), "src").rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = every.repartition("bucket").withColumn("__first", first).where(((F.col("__new") == F.col("__first")) | F.col("path").isNull()) & F.col("version").isNotNull())
    kept.drop("__new", "__first").select(*old.columns).write.option("compression", "zstd").partitionBy("bucket").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in buckets:
        now, new = path(f"{root}/bucket={b}"), path(f"{staged}/bucket={b}")
        files.delete(now, True)
        if files.exists(new) and not files.rename(new, now):
            raise OSError(f"{now} can't be replaced; its rows are in {staged}")
    remove(spark, staged)


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int").alias("bucket")


def read_sidecars(files: DataFrame, root: str) -> DataFrame:
    """Stored pages of files (path, mtime_ms, size): only those of this version whose time and size are the file's."""
    spark = files.sparkSession
    return spark.read.parquet(root).where(F.col("version") == SIDECAR_VERSION).join(files.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"])


def delete_sidecars(paths: DataFrame, root: str) -> None:
    """Removes documents (path); buckets without them are not touched."""
    stored = paths.sparkSession.read.parquet(root).schema
    gone = paths.select("path", bucket(F.col("path"))).distinct()
    rows = gone.select(*[F.col(f.name) if f.name in gone.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored])
    replace_buckets(rows, root, buckets_of(gone))


def scan_copies(pages: DataFrame) -> DataFrame:
    """Rows (path, text): the folded pages of a document in order, a line each. A document is one row of the file format."""
    held = pages.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("src", "folded"))).alias("p"))
    return held.select("path", F.array_join(F.transform("p", lambda x: x["folded"]), "\n").alias("text"))


def gram_index(spark: SparkSession, docs: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the index of documents (slot, folded) and gives its tables as they lie there: (gram, df, dropped) and postings,
    both sorted by gram, so that row groups that a lookup doesn't need are skipped."""
    root = root or folder(spark, "grams")
    search.gram_index(docs).sort("gram").write.parquet(f"{root}/index")
    index = spark.read.parquet(f"{root}/index")
    search.gram_postings(docs, index).sort("gram", "block").write.parquet(f"{root}/postings")
    return index, spark.read.parquet(f"{root}/postings")


def save_signature(files: DataFrame, root: str) -> None:
    signature(files).write.mode("overwrite").parquet(f"{root}/signature")


def usable(files: DataFrame, root: str) -> bool:
    """Whether the index at root was built of just these files."""
    spark = files.sparkSession
    if not exists(spark, f"{root}/signature"):
        return False
    return spark.read.parquet(f"{root}/signature").first() == signature(files).first()


def index_bytes(signature: int, paths: list[str], postings: dict[int, list[int] | None], always: list[int]) -> bytes:
    """An index of few documents as one file, all numbers little-endian: head, paths, directory by gram, lists, always.

    postings gives the sorted slots of a gram, None if it is dropped.
    """
    names = [p.encode() for p in paths]
    grams = sorted(postings)
    lists = [postings[g] or [] for g in grams]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    directory = np.stack([np.array(grams, dtype=np.int64), np.where([postings[g] is None for g in grams], 0, np.cumsum(size) - size), np.where([postings[g] is None for g in grams], DROPPED, size)], axis=1) if grams else np.zeros((0, 3), dtype=np.int64)
    slots = [s for x in lists for s in x]
    counted = lambda n, body: struct.pack("<I", n) + body
    return b"".join([
        struct.pack("<IIQ", MAGIC, VERSION, signature), counted(len(names), b"".join(counted(len(n), n) for n in names)), counted(len(grams), directory.astype("<u4").tobytes()),
        counted(len(slots), np.array(slots, dtype="<u4").tobytes()), counted(len(always), np.array(always, dtype="<u4").tobytes()),
    ])


def index_of_bytes(data: bytes) -> tuple[int, list[str], dict[int, list[int] | None], list[int]] | None:
    """What index_bytes() wrote, or None if the bytes are cut, of another version, or name places that are not there."""
    view, at = memoryview(data), 0

    def take(n: int) -> memoryview:
        nonlocal at
        if n > len(view) - at:
            raise ValueError("too short")
        at += n
        return view[at - n : at]

    def numbers(width: int = 1) -> np.ndarray:
        (n,) = struct.unpack("<I", take(4))
        return np.frombuffer(take(4 * width * n), dtype="<u4").reshape(n, width).astype(np.int64)

    try:
        magic, version, mark = struct.unpack("<IIQ", take(16))
        if (magic, version) != (MAGIC, VERSION):
            return None
        (n,) = struct.unpack("<I", take(4))
        paths = [str(take(struct.unpack("<I", take(4))[0]), "utf-8") for _ in range(n)]
        directory, slots, always = numbers(3), numbers()[:, 0], numbers()[:, 0]
    except (ValueError, struct.error):
        return None
    kept = directory[:, 2] != DROPPED
    if (directory[kept, 1] + directory[kept, 2] > len(slots)).any():
        return None
    lists = {int(g): slots[a : a + n].tolist() if n != DROPPED else None for g, a, n in directory.tolist()}
    return mark, paths, lists, always.tolist()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def replace_verified(rows: DataFrame, target: str, verify: Callable[[DataFrame], bool], before: Callable[[], None] = lambda: None) -> None:
    """Writes rows beside target, reads them back, and puts them in its place only if verify says so; else target stays as it was.

    The old table moves aside first and comes back if the last step fails.
    """
    spark = rows.sparkSession
    new, old = f"{target}.{uuid.uuid4().hex}.new", f"{target}.{uuid.uuid4().hex}.old"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.write.parquet(new)
        if not verify(spark.read.parquet(new)):
            raise ValueError(f"what was written for {target} is not what was meant")
        before()
        moved = files.exists(path(target)) and files.rename(path(target), path(old))
        if not files.rename(path(new), path(target)):
            if moved:
                files.rename(path(old), path(target))
            raise OSError(f"{target} can't be replaced")
        if moved:
            files.delete(path(old), True)
    finally:
        files.delete(path(new), True)


def save_catalog(entries: DataFrame, root: str, version: int = 2) -> None:
    """Entries by path, a JSON object a line, in files in that order; the version beside them."""
    entries.sort("path").write.mode("overwrite").json(f"{root}/entries")
    entries.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").json(f"{root}/meta")


def load_catalog(spark: SparkSession, root: str, files: DataFrame, schema: str, newest: int = 2) -> DataFrame:
    """Stored entries whose file is still there with the same time and size; none if a newer version wrote them."""
    meta = spark.read.schema("version int").json(f"{root}/meta").first()
    entries = spark.read.schema(schema).json(f"{root}/entries")
    if meta is None or meta.version is None or meta.version > newest:
        entries = entries.limit(0)
    return entries.join(files.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"], "left_semi")
