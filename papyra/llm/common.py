"""Helpers that several operators share: the shared folder, row identity and checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary folder if
    the session runs in this process alone (local master, as in tests); on a cluster that raises."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="papyra-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


#: What modules keep in a Python worker to save work within a task.
KEPT: list = []


def freeing(run: Callable) -> Callable:
    """A mapInArrow function whose Python worker, which lives on beside later stages, empties what is KEPT after each task and
    gives its free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for cache in KEPT:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


#: Rows that go to a Python worker, or come back, at a time.
BATCH_ROWS = 2048


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run meanwhile move BATCH_ROWS rows at a time, not Spark's 10,000: of whole texts, those are tens of MB, which
    the executor and each of its workers hold several times over, outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:  # 0 and less: no limit
        spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables of one operator call, written to the shared folder; a lost executor rereads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd")
        with small_batches(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def set_up_shared(spark: SparkSession) -> None:
    """DataFrame.checkpoint() needs a folder: the shared one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that to ASCII strings, and much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart where ids are null or repeat: the id (null: the least long) and two hashes of the text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text).alias("__t1")]


def small_or_merge(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """Broadcasts df if its counted rows are few; otherwise leaves a sort-merge join, whose skewed partitions Spark splits."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """Left join with a table that has one row a key, in which no key, however common, meets a single task.

    Keys that more than 1/parts of the left rows have are at most `parts`, so their rows of `right` are broadcast; the other
    keys are joined by a shuffle. left and right are read three times and twice: give written tables. Null keys match nothing.
    """
    total = left.count()
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * parts > total).select(*keys)
    common = F.broadcast(counts.dropna().withColumn("__common", F.lit(True)))
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    left = left.join(common, keys, "left")
    hot = left.where(F.col("__common")).drop("__common").join(F.broadcast(right.join(common, keys).drop("__common")), keys, "left")
    cold = left.where(F.col("__common").isNull() & some).drop("__common").join(right, keys, "left")
    none = left.where(~some).drop("__common")
    for c in right.columns:
        if c not in keys:
            none = none.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    return hot.unionByName(cold).unionByName(none)


def free_name(df: DataFrame, name: str) -> str:
    """The name of a column to add, which must not be taken."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    return name
