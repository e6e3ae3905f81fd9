"""Phrase search over pages, and the indexes that prune it without losing a match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions import text as tx

PER_DOCUMENT, DOCUMENTS, PER_PAGE, PER_QUERY = 20, 60, 200, 500
COMMON = 0.15


def counted(pages: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Pages (with normalized and folded) that hold the query, and how often: column n. The JVM-side test comes first."""
    prepared = tx.prepare_query(query, case_sensitive)
    hay = F.col("normalized" if case_sensitive else "folded")
    return pages.where(F.contains(hay, F.lit(prepared))).withColumn("n", tx.occurrences(hay, prepared)) if prepared else pages.limit(0).withColumn("n", F.lit(0))


def worth_reading(raw: Column, query: str) -> Column:
    """Whether a stored page's bytes may hold the prepared query: it does, or the query has a character that JSON escapes."""
    if any(c in '"\\' or ord(c) < 0x20 for c in query):
        return F.lit(True)
    return F.contains(raw, F.lit(query))


def library_search(pages: DataFrame, query: str, case_sensitive: bool = False, per_document: int = PER_DOCUMENT, documents: int = DOCUMENTS) -> DataFrame:
    """Ranked documents (path, total): the first `documents` by path that match, most matches first, then by path.

    A page gives at most per_document matches and so does a document. The cut by path comes before ranking. Only counts are
    sorted, and the limit is taken with partial top-k before the one task that ranks them.
    """
    hits = counted(pages, query, case_sensitive).groupBy("path").agg(F.sum(F.least("n", F.lit(per_document))).alias("all"))
    total = F.least("all", F.lit(per_document)).cast("long")
    return hits.select("path", total.alias("total")).orderBy("path").limit(documents).orderBy(F.desc("total"), "path")


def document_search(pages: DataFrame, query: str, case_sensitive: bool = False, per_page: int = PER_PAGE, per_query: int = PER_QUERY) -> DataFrame:
    """Rows (doc, src, n, truncated): matches of each page of each document under both caps, pages in order."""
    hits = counted(pages, query, case_sensitive).select("doc", "src", "n")
    before = F.coalesce(F.sum(F.least("n", F.lit(per_page))).over(W.partitionBy("doc").orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = hits.withColumn("kept", F.least("n", F.lit(per_page), F.greatest(F.lit(0), per_query - before)))
    cut = F.max(F.col("n") > F.col("kept")).over(W.partitionBy("doc"))
    return rows.withColumn("truncated", cut).where("kept > 0").select("doc", "src", F.col("kept").cast("long").alias("n"), "truncated")


def match_rows(pages: DataFrame, query: str, case_sensitive: bool = False, per_page: int = PER_PAGE) -> DataFrame:
    """A row for each match of pages (doc, src, raw, normalized, folded): (doc, src, start, len, snippet), the first two of those
    in raw text. Only pages that hold the query reach the kernel."""
    rows = counted(pages, query, case_sensitive)
    rows = rows.select("doc", "src", F.explode(tx.match_list(F.col("raw"), query, case_sensitive, per_page)).alias("m"))
    return rows.select("doc", "src", "m.*")


def library_hits(pages: DataFrame, query: str, case_sensitive: bool = False, per_document: int = PER_DOCUMENT, documents: int = DOCUMENTS) -> DataFrame:
    """Ranked documents with their pages: (rank, path, name, total, pages), pages an array of (src, matches).

    Documents come as in library_search. Pages of raw text (path, name, src, raw, normalized, folded) are taken in order, each
    with as many matches as the document has left of per_document; kernels run on the pages of the ranked documents alone.
    """
    found = library_search(pages, query, case_sensitive, per_document, documents)
    names = pages.groupBy("path").agg(F.first("name").alias("name"))
    ranked = F.broadcast(found)  # at most `documents` rows
    rows = counted(pages, query, case_sensitive).join(ranked, "path").withColumn("n", F.least("n", F.lit(per_document)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", per_document - before).where("left > 0")
    rows = rows.withColumn("matches", F.slice(tx.match_list(F.col("raw"), query, case_sensitive, per_document), F.lit(1), F.least("n", "left").cast("int")))
    held = rows.groupBy("path", "total").agg(F.sort_array(F.collect_list(F.struct("src", "matches"))).alias("pages"))  # per_document pages at most
    held = held.join(names.join(ranked.select("path"), "path"), "path")
    order = W.orderBy(F.desc("total"), F.col("name"), F.col("path"))
    return held.select(F.row_number().over(order).alias("rank"), "path", "name", "total", "pages")


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (gram, df): four-byte windows of the UTF-8 texts as numbers, each text's once, added up for some hundred texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [np.zeros(0, dtype=np.uint32)]
            for text in batch.column(0).slice(at, 512).to_pylist():
                data = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.uint32)
                if len(data) >= 4:
                    found.append(np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]))
            gram, df = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(df.astype(np.int64))], ["gram", "df"])


def gram_index(docs: DataFrame) -> DataFrame:
    """Rows (gram, df, dropped) of documents (slot, folded), a row each: grams in more than 15 % of them are dropped.

    Windows of bytes have no fast JVM-side form; counts leave Python already added up.
    """
    cutoff = max(1, -(-docs.count() * 15 // 100))
    counts = docs.select("folded").mapInArrow(gram_counts, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    return counts.select(F.lpad(F.hex("gram"), 8, "0").alias("gram"), "df", (F.col("df") > cutoff).alias("dropped"))


#: Slots that share a row of postings: so many slots that a row is bounded, however many documents there are.
BLOCK = 1 << 16


def grams_of(text: str) -> list[int]:
    """The different four-byte windows of a text's UTF-8, as numbers."""
    data = text.encode()
    return sorted({int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3)})


#: Pairs of a gram and a document that a Python worker sorts at a time, and documents that it reads at a time.
PAIRS, READ = 1 << 20, 256


def slots_by_gram(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """(slot, grams) of documents to rows (gram, block, slots), by one sort of numbers that have the gram above and the document below."""
    held.sort(key=lambda x: x[0])
    slots = np.array([slot for slot, _ in held], dtype=np.int64)
    pairs = np.concatenate([np.zeros(0, dtype=np.uint64), *(grams.astype(np.uint64) << np.uint64(32) | np.uint64(i) for i, (_, grams) in enumerate(held))])
    pairs.sort()
    gram, slot = (pairs >> np.uint64(32)).astype(np.int64), slots[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (slot[1:] // BLOCK != slot[:-1] // BLOCK)])) if len(gram) else np.zeros(0, dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(slot, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(slot[first] // BLOCK), lists], ["gram", "block", "slots"])


def gram_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, text) to (gram, block, slots): the documents that hold a gram, of so many at a time as have PAIRS grams."""
    held, pairs = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, READ):
            some = batch.slice(at, READ)
            for slot, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.uint32)
                if len(data) >= 4:
                    held.append((slot, np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:])))
                    pairs += len(held[-1][1])
                if pairs >= PAIRS:
                    yield slots_by_gram(held)
                    held, pairs = [], 0
    yield slots_by_gram(held)


def gram_postings(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (gram, block, slots) of documents (slot, folded): for each gram that `index` doesn't drop, its slots, sorted.

    Dropped grams are the long lists; they leave before the shuffle, by a broadcast of the few that more than 15 % of the
    documents hold (no more than 7 for each gram of a document). A row has one block of slots.
    """
    kept = docs.select("slot", "folded").mapInArrow(gram_slots, "gram long, block long, slots array<long>")
    common = index.where("dropped").select(F.conv("gram", 16, 10).cast("long").alias("gram"))
    kept = kept.join(common, "gram", "left_anti")
    return kept.groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("slots"))).alias("slots"))


def gram_candidates(index: DataFrame, postings: DataFrame, always: DataFrame, query: str) -> tuple[str, DataFrame | None]:
    """What an index says of a query: ("unknown", None) if it can't tell, else ("only", slots) that may hold it.

    The query's few grams are looked up in the index and in the postings, both sorted by gram, so that the filter reaches the
    scan; lists of a block are intersected by count. Rows of `always`, documents without text, may hold anything.
    """
    wanted = grams_of(tx.fold(query))
    if not wanted:
        return "unknown", None
    known = {r.gram: r.dropped for r in index.where(F.col("gram").isin([f"{g:08X}" for g in wanted])).collect()}
    if len(known) < len(wanted):
        return "only", always.select("slot")
    usable = [g for g in wanted if not known[f"{g:08X}"]]
    if not usable:
        return "unknown", None
    lists = postings.where(F.col("gram").isin(usable)).select("gram", F.explode("slots").alias("slot"))
    found = lists.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") == len(usable)).select("slot")
    return "only", found.union(always.select("slot")).distinct()


#: Symbols of a trigram: A to Z, then digit, white space and all else.
DIGIT, SPACE, OTHER = "[", "\\", "]"


def trigram_symbols(text: Column) -> Column:
    """Text over 29 symbols: letters without case, digits, white space, all else."""
    out = F.upper(F.regexp_replace(text, r"[^A-Za-z0-9\x09-\x0D\x20]", OTHER))
    return F.translate(out, "0123456789 \t\n\x0b\x0c\r", DIGIT * 10 + SPACE * 6)


def trigrams_of(query: str) -> list[str]:
    """The distinct trigrams of a query, as symbols."""
    kind = lambda c: c.upper() if c.isascii() and c.isalpha() else DIGIT if c in "0123456789" else SPACE if c in " \t\n\x0b\x0c\r" else OTHER
    s = "".join(map(kind, query))
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def trigram_number(symbols: str) -> int:
    kind = lambda c: 26 if c == DIGIT else 27 if c == SPACE else 28 if c == OTHER else ord(c) - ord("A")
    return kind(symbols[0]) << 10 | kind(symbols[1]) << 5 | kind(symbols[2])


def admits(text: Column, query: str) -> Column:
    """Whether a text has every trigram of the query, where no bitmap of it is stored."""
    symbols, ok = trigram_symbols(text), F.lit(True)
    for t in trigrams_of(query):
        ok = ok & F.contains(symbols, F.lit(t))
    return ok


def bitmap_admits(bits: Column, query: str) -> Column:
    """Whether a bitmap of trigrams has every one of the query, so that its document may hold it. A query of fewer than three
    characters is always admitted. The bits of a byte lie from the highest to the lowest."""
    ok = F.lit(True)
    for t in trigrams_of(query):
        n = trigram_number(t)
        byte = F.conv(F.hex(F.substring(bits, n // 8 + 1, 1)), 16, 10).cast("int")
        ok = ok & (byte.bitwiseAND(0x80 >> n % 8) != 0)
    return ok


def _symbol_codes() -> np.ndarray:
    """Number of a symbol by byte of UTF-8; 255 for bytes inside a character."""
    codes = np.full(256, 28, dtype=np.uint8)
    codes[0x80:0xC0] = 255
    for c in range(26):
        codes[0x41 + c] = codes[0x61 + c] = c
    codes[0x30:0x3A] = 26
    codes[[0x20, 9, 10, 11, 12, 13]] = 27
    return codes


def trigram_bitmap(pages: list[str | None]) -> bytes:
    """4096 bytes: a bit for each trigram that a page has, by number of its symbols (5 bits each)."""
    seen, codes = np.zeros(1 << 15, dtype=bool), _symbol_codes()
    for page in pages:
        s = codes[np.frombuffer((page or "").encode(), dtype=np.uint8)]
        s = s[s < 255].astype(np.int64)
        seen[s[:-2] << 10 | s[1:-1] << 5 | s[2:]] = True
    return np.packbits(seen).tobytes()


def bitmap_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to (key, bits), 4 kB each, READ of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, READ):
            some = batch.slice(at, READ)
            bits = [trigram_bitmap((t or "").split("\n")) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(bits, pa.binary())], [key, "bits"])


def trigram_bitmaps(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, bits) of documents whose pages are the lines of text: one map-only pass."""
    return docs.select(key, text).mapInArrow(lambda batches: bitmap_rows(batches, key), f"{key} {docs.schema[key].dataType.simpleString()}, bits binary")
