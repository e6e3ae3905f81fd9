"""From documents to packed sequences: language, lines, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet and reads it for the next.
All but the last return the columns of documents. No stage has SQL for its whole result, so ORACLE_SQL is None;
tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import Scratch, row_key
from papyra.llm.langid import UNKNOWN, identify
from papyra.llm.line_dedup import dedup_lines
from papyra.llm.mixing import WORD_AND_SPACE, mix_sources
from papyra.llm.neardup import near_duplicates
from papyra.llm.packing import pack_documents

#: A text of which less than this share of letter n-grams belongs to any one language is rejected.
LEAST_SCORE = 0.25


def columns_with(row: str, schema: DataFrame, **new) -> list:
    """The columns of schema out of struct column `row`, some replaced."""
    return [new.get(c, F.col(f"{row}.`{c}`")).cast(schema.schema[c].dataType).alias(c) for c in schema.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters and texts in no learned language; a null lang is filled with the prediction."""
    rows = identify(docs, "__language")
    kept = rows.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__language.lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes shared lines out of texts; all rows stay, with n_chars of the new text."""
    rows = dedup_lines(docs)
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return rows.select(*columns_with("row", docs, text=text, n_chars=F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest id stays, of equal or null ids that of the least text hash; of rows that repeat id and text, one."""
    key = row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))
    stay = near_duplicates(docs.select("doc_id", "text")).where((F.col("__id") == F.col("class_id")) & (F.col("__t1") == F.col("class_t1"))).select("__id", "__t1").distinct()
    rows = docs.select(F.struct("*").alias("row"), *key).join(stay, ["__id", "__t1"])
    return rows.dropDuplicates(["__id", "__t1"]).select(*columns_with("row", docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy the mix takes, of the whole text or of the words of a block range."""
    rows = mix_sources(docs)
    whole = F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    rows = rows.select("row", "size", F.explode(F.concat(F.array_repeat(whole, F.col("copies").cast("int")), "parts")).alias("p"))
    is_whole = (F.col("p.from") == 0) & (F.col("p.to") == F.col("size"))
    words = F.regexp_extract_all("row.text", F.lit(WORD_AND_SPACE), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("p.from") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int")), "")
    rows = rows.withColumn("text", F.when(is_whole, F.col("row.text")).otherwise(part))
    return rows.select(*columns_with("row", docs, text=F.col("text"), n_chars=F.when(is_whole, F.col("row.n_chars")).otherwise(F.char_length("text"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        scratch.write(stage(spark, docs, sf_dir), name)
        docs = scratch.read(name)
    return docs
