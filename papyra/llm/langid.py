"""Language identification by language-bitmask n-gram filters.

Each language's frequent letter n-grams go into a Bloom filter. All filters share one table, bit-sliced: slot s holds a
mask with a bit for each language, so the AND of an n-gram's few slots gives at once all languages that contain it.
For a text, the bits are counted for each language, and each count is corrected for the filter's measured rate of
false positives; the largest corrected share of the text's n-grams decides.

Learning counts the n-grams of all labelled texts, summed within a task while they are few; it keeps at most `grams` n-grams
a language, and 2**20 in all: beyond 52 languages each has fewer. Filters have a slot of 1 bit for each language in each of
2**20 places, in words of 64 languages, however many languages there are.
Prediction is one map-only pass over whole texts. Texts beyond PIECE characters are read in pieces that end between words;
within a longer word pieces overlap, so that each n-gram counts once (at such a cut one of three letters counts twice).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import Scratch, free_name, freeing

UNKNOWN = "und"
SIZES = (3, 4)
PIECE, OVERLAP = 1 << 17, max(SIZES) - 1
#: Counts that a task holds while it learns.
HELD = 1 << 21
_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Index and text in groups of at most about PIECE characters, and whether a text goes on within a word. Longer texts are cut."""
    index, group, cut, held = [], [], [], 0
    for i, text in enumerate(texts):
        start, inside = 0, False
        while start < len(text):
            end = start + PIECE
            space = 0
            if end < len(text):
                space = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end)) + 1
                end = space or end
            goes_on = end < len(text) and not space
            if inside and not group:  # the word has begun in the group before
                index, group, cut = [i], [""], [True]
            index.append(i)
            group.append(text[start : end + OVERLAP if goes_on else end].lower())
            cut.append(goes_on)
            held += len(group[-1])
            start, inside = end, goes_on
            if held >= PIECE:
                yield index, group, cut
                index, group, cut, held = [], [], [], 0
    if group:
        yield index, group, cut


def grams(group: list[str], cut: list[bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of the n-grams of words (with their bounds) and the place in group of the text they are in."""
    joined = ("\n" + "\n".join(group) + "\n").encode("utf-32-le", "replace")
    codes = np.frombuffer(joined, dtype=np.uint32)
    ends = np.cumsum([len(g) + 1 for g in group])
    letter = is_letter()[codes]
    stay = letter.copy()
    stay[1:] |= letter[:-1]  # one bound after each word
    stay[0] = True
    broken = np.zeros(len(codes), dtype=bool)
    broken[ends[np.asarray(cut, dtype=bool)]] = True  # no bound: the word goes on
    stay |= broken
    at = np.flatnonzero(stay)
    c = np.where(letter[at], codes[at], 0).astype(np.uint64)
    inside, whole = c != 0, ~broken[at]
    doc = np.searchsorted(ends, at - 1, side="right").astype(np.int32)
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        ok = np.ones(len(h), dtype=bool)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)]
            ok &= whole[k : k + len(h)]
            if 0 < k < n - 1:
                ok &= inside[k : k + len(h)]
        h = h[ok]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        yield h, doc[1 : len(ok) + 1][ok]


class Filters:
    """The bit-sliced Bloom filters of all languages; slots is a power of two."""

    def __init__(self, langs: list[str], members: list[np.ndarray], slots: int = 1 << 20, probes: int = 4):
        self.langs, self.slots, self.probes = langs, slots, probes
        kind = next((t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(langs) <= bits), np.uint64)
        per = np.dtype(kind).itemsize * 8
        self.tables = [np.zeros(slots, dtype=kind) for _ in range(0, len(langs), per)]
        self.per = per
        for i, keys in enumerate(members):
            for p in range(probes):
                self.tables[i // per][self._slot(keys, p)] |= kind(1 << (i % per))
        fill = np.array([np.count_nonzero(self.tables[i // per] & kind(1 << (i % per))) / slots for i in range(len(langs))])
        self.false_rate = fill**probes

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        odd = np.uint64((0xD1342543DE82EF95 * (2 * probe + 1)) % 2**64)
        return ((keys * odd) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each table, the languages that contain each key."""
        slots = [self._slot(keys, p) for p in range(self.probes)]
        out = []
        for table in self.tables:
            m = table[slots[0]]
            for s in slots[1:]:
                m &= table[s]
            out.append(m)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = np.zeros((len(self.langs), len(texts)))
        total, lettered = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for index, group, cut in pieces([t or "" for t in texts]):
            place = np.asarray(index)
            for keys, doc in grams(group, cut):
                doc = place[doc]
                total += np.bincount(doc, minlength=len(texts))
                for b, masks in enumerate(self.masks(keys)):
                    for bit in range(min(self.per, len(self.langs) - b * self.per)):
                        hit = (masks >> masks.dtype.type(bit)) & masks.dtype.type(1)
                        found[b * self.per + bit] += np.bincount(doc, weights=hit, minlength=len(texts))
        lettered |= total > 0
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rate = self.false_rate[:, None]
        share = np.clip((found - total * rate) / (1 - rate) / np.maximum(total, 1), 0, 1).round(9)  # equal counts tie
        best = share.argmax(axis=0)
        return [self.langs[i] if y else UNKNOWN for i, y in zip(best, lettered, strict=True)], [float(s) if y else 0.0 for s, y in zip(share.max(axis=0), lettered, strict=True)]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of several (keys, counts), and the sum of each key's counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, gram, n), summed within a task; counts leave when HELD / 2 n-grams or more are different."""
    held, size = {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for keys, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
            for _, group, cut in pieces(own):
                for keys, _doc in grams(group, cut):
                    if not len(keys):
                        continue
                    k, n = np.unique(keys.view(np.int64), return_counts=True)
                    held.setdefault(lang, []).append((k, n.astype(np.int64)))
                    size += len(k)
                if size >= HELD:
                    held = {x: [summed(parts)] for x, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size >= HELD // 2:
                        yield from out()
                        held, size = {}, 0
    held = {x: [summed(parts)] for x, parts in held.items()}
    yield from out()


def cut(histogram: DataFrame, left: dict[str, int], falling: bool = False) -> dict[str, tuple[int, int]]:
    """From rows (lang, v, rows), for each language of `left` that has more rows than it may keep: the v at which they end, in
    rising or falling order, and how many rows of this v stay."""
    found = histogram.toArrow()
    langs = np.asarray(pc.index_in(found.column("lang"), pa.array(list(left), pa.string())))
    v, rows, out = np.asarray(found.column("v")), np.asarray(found.column("rows")), {}
    for i, (lang, most) in enumerate(left.items()):
        own = np.flatnonzero(langs == i)
        own = own[np.argsort(-v[own] if falling else v[own])]
        ends = np.cumsum(rows[own])
        if len(own) and ends[-1] > most:
            k = int(np.searchsorted(ends, most))
            out[lang] = int(v[own[k]]), int(most - ends[k] + rows[own[k]])
    return out


def most_frequent(counted: DataFrame, langs: list[str], most: int) -> DataFrame:
    """Of rows (lang, gram, n), those of the `most` largest n of each language; ties go to smaller grams.

    A language's rows never meet in one task: counts of the rows of each n, then of each value of the first 16 bits of the
    grams that tie, come to the driver and tell where to cut; the few grams that share those bits come as they are.
    """
    spark = counted.sparkSession
    at = cut(counted.groupBy("lang", F.col("n").alias("v")).agg(F.count("*").alias("rows")), dict.fromkeys(langs, most), falling=True)
    if not at:
        return counted
    ends = spark.createDataFrame([(x, v) for x, (v, _) in at.items()], "lang string, end long")
    ties = counted.join(F.broadcast(ends), "lang").where(F.col("n") == F.col("end"))
    bits = F.shiftright("gram", 48)
    first = cut(ties.groupBy("lang", bits.alias("v")).agg(F.count("*").alias("rows")), {x: stay for x, (_, stay) in at.items()})
    prefix = spark.createDataFrame([(x, v) for x, (v, _) in first.items()], "lang string, prefix long")
    last = cut(ties.join(F.broadcast(prefix), "lang").where(bits == F.col("prefix")).select("lang", F.col("gram").alias("v"), F.lit(1).alias("rows")), {x: stay for x, (_, stay) in first.items()})
    # where all rows of an n or of a prefix stay, nothing after it is cut
    top = 2**63 - 1
    limit = {x: last[x][0] if x in last else ((first[x][0] + 1 << 48) - 1 if x in first else top) for x in at}
    limits = spark.createDataFrame([(x, v, limit[x]) for x, (v, _) in at.items()], "lang string, end long, upto long")
    rows = counted.join(F.broadcast(limits), "lang", "left")
    stay = F.col("end").isNull() | (F.col("n") > F.col("end")) | (F.col("n") == F.col("end")) & (F.col("gram") <= F.col("upto"))
    return rows.where(stay).select("lang", "gram", "n")


def fit(labelled: DataFrame, grams: int = 20_000, least_part: float = 0.05) -> Filters:
    """Learns from all rows (text, lang) whose lang is not null. Languages are ordered by number of rows, then name; ties go to the first.

    A language contains an n-gram if its share of the language's n-grams is at least least_part of its share in the
    language where that is largest: quotations and mislabelled texts don't count. The values of lang, a code each, come to
    the driver, with at most `grams` n-grams each and 2**20 in all, but at least one each.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    langs = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not langs:
        return Filters([], [])
    counted = labelled.select("lang", "text").mapInArrow(freeing(gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    scratch = Scratch(labelled.sparkSession, "language-id")
    counted = scratch.write(counted, "grams")
    all_of = counted.groupBy("lang").agg(F.sum("n").alias("all"))  # a row for each language
    counted = counted.join(F.broadcast(all_of), "lang").withColumn("part", F.col("n") / F.col("all")).drop("all")
    by_gram = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n", "part")).alias("in"))  # a row for each language at most
    largest = F.array_max(F.transform("in", lambda x: x["part"]))
    counted = by_gram.select("gram", F.explode(F.filter("in", lambda x: x["part"] >= least_part * largest)).alias("x")).select("gram", "x.lang", "x.n")
    most = max(1, min(grams, (1 << 20) // len(langs)))
    names = [r["lang"] for r in langs]
    top = most_frequent(scratch.write(counted, "own"), names, most).select("lang", "gram").toArrow()
    index, keys = np.asarray(pc.index_in(top.column("lang"), pa.array(names, pa.string()))), np.asarray(top.column("gram")).view(np.uint64)
    return Filters(names, [keys[index == i] for i in range(len(names))])


def predicted(sent, text: int):
    """Appends struct (lang_pred, score) to rows whose texts are in column number `text`, a few hundred texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = sent.value.predict(part.column(text).to_pylist())
                guess = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
                yield pa.RecordBatch.from_arrays([*part.columns, guess], [*part.schema.names, "__guess"])

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) is divisible by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, into: str = "language") -> DataFrame:
    """Adds struct column `into`: held_out, lang_pred, score; learns from the rows of docs that are not held out.

    Texts alone decide: equal texts, equal values. Null texts and texts without letters are `und`, with score 0; without
    labelled rows all texts are. A text none of whose n-grams are known gets the most frequent language, score 0.
    Rows and columns of docs all stay, repeats included; a taken name `into` raises. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    free_name(docs, into)
    filters = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    sent = spark.sparkContext.broadcast(filters)
    schema = T.StructType([*docs.schema, T.StructField("__guess", T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))])
    rows = docs.mapInArrow(freeing(predicted(sent, docs.columns.index("text"))), schema)
    judged = F.struct(held_out(F.col("doc_id")).alias("held_out"), F.col("__guess.lang_pred"), F.col("__guess.score"))
    return rows.withColumn(into, judged).drop("__guess")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "language.held_out", "language.lang_pred", "language.score")
