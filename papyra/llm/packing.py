"""Lexical retrieval packing: windows filled with a document and the unused documents that BM25 finds nearest to it.

df, idf and mean length are those of all documents, and whole texts are indexed and are queries. A document longer than a
window first gives up whole windows; what is left of it is packed. A seed takes its window, and the best documents of its
shard not yet used follow by BM25 score until the window is full; the last one is cut, and its rest seeds the next window.

The index is sharded by content: documents are sorted by the `LEADS` terms of largest BM25 weight, and each run of
`local_docs` documents of that order is a shard. So documents that share what is most telling in them meet in a shard at
every corpus size, and a group of any size, copies included, is cut into shards of bounded size. One pass tokenizes and
counts all documents; a second reads the ids and finds what leads each document, by the idf and mean length of all. A term
that only one document has leads nothing. One shuffle, of ids, makes the order; work grows in proportion to the input.

A shard leaves one open window at most. Open windows are units of the next level, which packs them in the same way, in the
same order; so each level has 1/local_docs of the units of the one before, and the last, of one shard, cuts what is left
into sequences of powers of two: no padding at all. The driver holds counts alone, and a table of the tokenizer's ids.

Weights are rounded to 1/UNIT, so that sums are exact; equal scores go by the order of documents.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import Scratch, freeing, row_key

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Bytes of text that are split at a time.
SLICE = 1 << 21
#: BM25, and parts of 1 that weights are rounded to.
K1, B, UNIT = 1.2, 0.75, 256
#: Terms by which documents are sorted, and tokens at which a shard ends, however few its documents are.
LEADS, SHARD_TOKENS = 3, 1 << 21
#: How the tokenizer that Encoder knows normalizes and splits texts.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordBpe:
    """The tokenizer's merges applied to many words at once: the leftmost pair of least rank, until no pair merges.

    For words of ASCII and Latin-1 letters alone, lower-cased, which its normalizer and its splitting leave whole; the
    tokenizer itself encodes all else. The tests hold both to the same ids.
    """

    SLOTS = 19
    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        names = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(sorted({*range(256)} - {*shown}))}
        self.inner = np.array([vocab[names[c]] for c in range(256)], dtype=np.int32)
        self.last = np.array([vocab[names[c] + suffix] for c in range(256)], dtype=np.int32)
        self.keys = np.full(1 << self.SLOTS, -1, dtype=np.int64)
        self.rank, self.to = np.full(1 << self.SLOTS, self.NONE, dtype=np.int32), np.zeros(1 << self.SLOTS, dtype=np.int32)
        for rank, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[one] << 16 | vocab[two]
            slot = self._slot(key)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << self.SLOTS)
            self.keys[slot], self.rank[slot], self.to[slot] = key, rank, vocab[one + two]

    def _slot(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.SLOTS)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slot of each pair; the slot of an absent pair has rank NONE."""
        key = one.astype(np.int64) << 16 | two
        slot = self._slot(key)
        wrong = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % (1 << self.SLOTS)
            found = self.keys[slot[wrong]]
            wrong = wrong[(found != key[wrong]) & (found >= 0)]
        return slot

    def encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (rows of bytes, of which the first `sizes` count), and how many there are of each."""
        width, rows = raw.shape[1], np.arange(len(raw))
        out, counts = np.zeros(raw.shape, dtype=np.int32), sizes.copy()
        ids = self.inner[raw]
        ids[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        slot = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raw), width - 1)
        rank, to = self.rank[slot], self.to[slot]
        rank[np.arange(width - 1) >= sizes[:, None] - 1] = self.NONE
        row = rows
        while width > 1:
            at = rank.argmin(axis=1)
            live = rank[rows[: len(row)], at] != self.NONE
            if not live.all():
                out[row[~live], :width] = ids[~live]
                row, ids, rank, to, at = row[live], ids[live], rank[live], to[live], at[live]
            if not len(row):
                return out, counts
            width -= 1
            counts[row] -= 1
            every, cols = rows[: len(row)], np.arange(width)
            ids[every, at] = to[every, at]
            ids = ids[every[:, None], cols + (cols > at[:, None])]
            cols = cols[:-1]
            past = cols + (cols >= at[:, None])
            rank, to = rank[every[:, None], past], to[every[:, None], past]
            for side in (at - 1, at):  # the pairs that the new symbol is in
                has = np.flatnonzero((side >= 0) & (side < counts[row] - 1))
                if len(has):
                    slot = self._find(ids[has, side[has]], ids[has, side[has] + 1])
                    rank[has, side[has]], to[has, side[has]] = self.rank[slot], self.to[slot]
        out[row, :width] = ids
        return out, counts


class Encoder:
    """Ids of texts: for a tokenizer that lower-cases and splits as KNOWN_NORMALIZER and KNOWN_SPLIT say, as those of their
    words between white space, which it never joins; for any other file, by the tokenizer itself."""

    MARKS, WIDTHS = ".,", (6, 9, 12, 16, 32)

    def __init__(self, path: str | None):
        # a task has one core: the tokenizer's threads take CPU seconds, and each keeps a heap of its own in every worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        model = json.loads(Path(path).read_text())
        steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        bpe = model["model"].get("type") == "BPE" and model["model"].get("end_of_word_suffix") and not model["model"].get("ignore_merges")
        self.known = bool(bpe) and model.get("normalizer") == KNOWN_NORMALIZER and (steps[0].get("pattern") or {}).get("Regex") == KNOWN_SPLIT and model.get("post_processor") is None
        if not self.known:
            return
        self.plain = WordBpe(path)
        self.marks = np.array([0, *(self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in self.MARKS)], dtype=self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        ids, sizes = self.ids(pa.array(texts, pa.large_string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without nulls, and how many each has. Each different word is encoded once."""
        if not self.known:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for own in found for i in own], dtype=self.kind), np.array([len(own) for own in found], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = np.asarray(split.offsets)
        words = split.flatten().dictionary_encode()
        at = np.asarray(words.indices)
        data, size = self._encoded(words.dictionary.cast(pa.large_string()))
        start, size = np.cumsum(size) - size, size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = data[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], size)]
        first = first - first[0]
        return ids, ends[first[1:]] - ends[first[:-1]]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has: letters with one of MARKS at most by WordBpe, words of
        similar lengths at once; others by the tokenizer."""
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset :]
        data = np.frombuffer((words.buffers()[2] or pa.py_buffer(b"")).to_pybytes() + bytes(self.WIDTHS[-1]), dtype=np.uint8)
        starts, ends = bounds[:-1], bounds[1:]
        mark = np.zeros(len(words), dtype=np.int64)
        for k, m in enumerate(self.MARKS, 1):
            mark[(ends > starts) & (data[ends - 1] == ord(m))] = k
        sizes = ends - starts - (mark > 0)
        # Lower case, in place: A-Z, and the Latin-1 capitals, which follow byte C3 in UTF-8. C3 97 and C3 B7 are no letters.
        second = np.concatenate([[False], data[:-1] == 0xC3])
        capital = (data >= 0x41) & (data <= 0x5A) | second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = data + capital.astype(np.uint8) * np.uint8(32)
        letter = (low >= 0x61) & (low <= 0x7A) | (low == 0xC3) & ~second | second & (data != 0x97) & (data != 0xB7)
        others = np.concatenate([[0], np.cumsum(~letter)])
        plain = (others[starts + sizes] == others[starts]) & (sizes >= 1) & (sizes <= self.WIDTHS[-1])
        counts, parts = np.zeros(len(words), dtype=np.int64), []
        for above, width in zip((0, *self.WIDTHS), self.WIDTHS):
            of_size = np.flatnonzero(plain & (sizes > above) & (sizes <= width))
            for at in range(0, len(of_size), 1 << 14):
                word = of_size[at : at + (1 << 14)]
                ids, counts[word] = self.plain.encode(low[starts[word][:, None] + np.arange(width)], sizes[word])
                parts.append((word, ids))
        rest = np.flatnonzero(~plain & (ends > starts))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        counts[rest] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        marked = plain & (mark > 0)
        place = np.cumsum(counts + marked) - counts - marked
        out = np.zeros(int((counts + marked).sum()), dtype=self.kind)
        for word, ids in parts:
            cols = np.arange(ids.shape[1])
            live = cols < counts[word][:, None]
            out[(place[word][:, None] + cols)[live]] = ids[live]
        out[np.repeat(place[rest] - np.cumsum(counts[rest]) + counts[rest], counts[rest]) + np.arange(counts[rest].sum())] = np.array([i for own in found for i in own], dtype=self.kind)
        out[(place + counts)[marked]] = self.marks[mark[marked]]
        return out, counts + marked


_encoders: dict = {}


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE bytes of a column, as even as rows allow."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)))
    parts = round(size[-1] / SLICE) if len(size) else 0
    part = size[-1] / parts if parts else SLICE
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + part)) + 1
        yield batch.slice(at, end - at)
        at = end


TOKENS = "doc_id long, __id long, __t1 long, ids binary, width int, df binary"
LED = "doc_id long, __id long, __t1 long, ids binary, width int, lead1 long, lead2 long, lead3 long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What a level gives: pieces of full sequences, and open windows (pos, parts of documents, terms and weights of the seed).
PART = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64())])
OPEN = "pos long, parts array<struct<doc_id:long,start:long,ids:binary,tokens:long>>, terms binary, weight binary"
LEVEL = f"{PIECES}, {OPEN}"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def joined(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many there are of each blob."""
    return np.frombuffer(b"".join(blobs), dtype=kind), np.array([len(x) for x in blobs], dtype=np.int64) // np.dtype(kind).itemsize


def blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of which each row has the bytes of the next `sizes` values."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def counted(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of each document in ascending order, how often each occurs, and how many a document has."""
    key = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32 | ids)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    own = key[first]
    return own & 0xFFFFFFFF, np.diff(np.append(first, len(key))), np.bincount(own >> 32, minlength=len(sizes))


def ended(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts END behind each document's ids."""
    out = np.full(len(ids) + len(sizes), END, dtype=ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


def weights(tf: np.ndarray, idf: np.ndarray, size: float | np.ndarray, mean: float) -> np.ndarray:
    return np.rint(UNIT * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))


def leads(terms: np.ndarray, tf: np.ndarray, own: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> list[np.ndarray]:
    """The terms of largest weight of each document, -1 where there are fewer of any weight."""
    weight = weights(tf, idf[terms], np.repeat(sizes, own), mean).astype(np.int64)
    key, first, out = weight << 32 | (0xFFFFFFFF - terms.astype(np.int64)), np.cumsum(own) - own, []
    for _ in range(LEADS):
        top = np.maximum.reduceat(key, first)
        out.append(np.where(top >> 32 > 0, 0xFFFFFFFF - (top & 0xFFFFFFFF), -1))
        key[key == np.repeat(top, own)] = 0
    return out


def tokenized(path: str | None):
    """Rows (doc_id, __id, __t1, text) to TOKENS, some MB of text at a time; a last row has the task's counts alone: documents,
    tokens, terms, and the documents of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u4" if enc.kind.itemsize > 2 else "<u2")
        df, n, tokens = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            for own in slices(batch, 3):
                ids, sizes = enc.ids(own.column(3).fill_null(""))
                ids, sizes = ended(ids.astype(kind, copy=False), sizes)
                terms, _, _ = counted(ids, sizes)
                part = np.bincount(terms, minlength=len(df))
                part[: len(df)] += df
                df, n, tokens = part, n + len(sizes), tokens + len(ids)
                columns = [blobs(ids, sizes), pa.array(np.full(len(own), kind.itemsize, dtype=np.int32)), pa.nulls(len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(3)), *columns], names(TOKENS))
        term = np.flatnonzero(df)
        last = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32())]
        yield pa.RecordBatch.from_arrays([*last, pa.array([np.concatenate([[n, tokens], term, df[term]]).astype("<i8").tobytes()], pa.binary())], names(TOKENS))

    return run


def led(sent):
    """Rows of TOKENS, without df, to LED, some MB of ids at a time. sent: idf, 0 of terms that lead nothing, and mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = sent.value
        for batch in batches:
            for own in slices(batch, 3):
                ids, sizes = joined(own.column(3).to_pylist(), f"<u{own.column(4)[0].as_py()}")
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, leads(*counted(ids, sizes), sizes, idf, mean))], names(LED))

    return run


def term_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (df) to (term, n); -1 counts documents and -2 tokens."""
    for batch in batches:
        for df in batch.column(0).to_pylist():
            term, n = np.frombuffer(df, "<i8", offset=16).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(n, np.frombuffer(df, "<i8", 2)))], ["term", "n"])


def statistics(rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of documents, mean length and documents of each term; as many rows as the tokenizer has ids come to the driver."""
    found = rows.where(F.col("df").isNotNull()).select("df").mapInArrow(term_df, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, count = np.asarray(found.column("term")), np.asarray(found.column("n"))
    if not len(term):
        return 0, 1.0, np.zeros(0)
    df = np.zeros(int(term.max()) + 1)
    df[term[term >= 0]] = count[term >= 0]
    n, tokens = int(count[term == -1][0]), int(count[term == -2][0])
    return n, max(tokens / max(n, 1), 1e-9), df


class Shard:
    """Inverted index of some units, given by their terms and weights."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, sizes: np.ndarray):
        self.n, self.ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms, kind="stable")
        self.doc, self.value = np.repeat(np.arange(self.n), sizes)[order], weight[order].astype(np.float64)
        known, self.first, self.count = np.unique(terms[order], return_index=True, return_counts=True)
        self.slot = np.searchsorted(known, terms)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score, in parts of 1/UNIT, of each unit for the terms of the seed."""
        own = self.slot[self.ends[seed] : self.ends[seed + 1]]
        size = self.count[own]
        place = np.arange(size.sum()) + np.repeat(self.first[own] - np.cumsum(size) + size, size)
        return np.bincount(self.doc[place], weights=self.value[place], minlength=self.n)


def shard_of(rests: list[np.ndarray]) -> Shard:
    """BM25 over these documents alone, for pack() without an index."""
    ids, sizes = np.concatenate([np.asarray(r) for r in rests] or [np.zeros(0)]).astype(np.int64), np.array([len(r) for r in rests], dtype=np.int64)
    terms, tf, own = counted(ids, sizes)
    df = np.bincount(terms)
    idf, mean = np.log(1 + (len(rests) - df + 0.5) / (df + 0.5)), max(float(sizes.mean()) if len(sizes) else 0.0, 1e-9)
    return Shard(terms, weights(tf, idf[terms], np.repeat(sizes, own), mean), own)


def pack(rests: list, window: int, index=None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, from, to) that hold each token of the rests once; the last may be short."""
    index = index or shard_of(rests)
    used = np.array([len(r) == 0 for r in rests])
    at = [0] * len(rests)
    order = iter(range(len(rests)))
    seed = None
    while True:
        if seed is None:
            seed = next((d for d in order if not used[d]), None)
            if seed is None:
                return
        pieces, room = [], window
        used[seed] = True
        nearest = iter([seed])
        cut, looked = None, False
        while room:
            d = next(nearest, None)
            if d is None:
                if looked:
                    break
                looked = True
                score = index.scores(seed)
                score[used] = -1.0
                best = np.argsort(-score, kind="stable")
                nearest = iter(best[score[best] >= 0].tolist())
                continue
            take = min(room, len(rests[d]) - at[d])
            pieces.append((d, at[d], at[d] + take))
            at[d] += take
            room -= take
            used[d] = True
            if at[d] < len(rests[d]):
                cut = d
        yield pieces
        seed = cut


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a sequence into sequences whose lengths are powers of two, the longest first."""
    left = sum(b - a for _, a, b in pieces)
    queue = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            d, a, b = queue.pop()
            take = min(room, b - a)
            out.append((d, a, a + take))
            room -= take
            if a + take < b:
                queue.append((d, a + take, b))
        yield out


class Packer:
    """Packs a partition's units, in order, shard by shard. A unit is (parts, terms, weights), a part (doc_id, start, ids, tokens)."""

    def __init__(self, level: int, window: int, local_docs: int | None):
        self.level, self.window, self.local_docs = level, window, local_docs  # without local_docs: one shard, the last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        self.sequence, self.pieces, self.open = self.level << 56 | part << 32, [], []
        held, tokens, shards = [], 0, 0
        for unit in self.units(batches):
            held.append(unit)
            tokens += sum(len(p[2]) for p in unit[0])
            if self.local_docs and (len(held) >= self.local_docs or tokens >= SHARD_TOKENS):
                self.shard(held, part << 32 | shards)
                held, tokens, shards = [], 0, shards + 1
                if len(self.pieces) >= 4096:
                    yield self.batch()
        if held:
            self.shard(held, part << 32 | shards)
        yield self.batch()

    def units(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of OPEN as units."""
        for batch in batches:
            for parts, terms, weight in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                yield [(p["doc_id"], p["start"], np.frombuffer(p["ids"], "<u4"), p["tokens"]) for p in parts], np.frombuffer(terms, "<u4"), np.frombuffer(weight, "<i4")

    def emit(self, parts: Iterator[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in parts:
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def indexed(self, units: list) -> Shard:
        terms, weight = (np.concatenate([u[k] for u in units]) for k in (1, 2))
        return Shard(terms, weight, np.array([len(u[1]) for u in units]))

    def shard(self, units: list, pos: int) -> None:
        index = self.indexed(units)
        for pieces in pack([range(sum(len(p[2]) for p in u[0])) for u in units], self.window, index):
            size = sum(b - a for _, a, b in pieces)
            if size == self.window:
                self.emit(self.cut(units, pieces))
            elif self.local_docs:
                seed = pieces[0][0]
                own = slice(index.ends[seed], index.ends[seed + 1])
                terms, weight = self.vectors(units, index, seed, own)
                parts = [{"doc_id": d, "start": s, "ids": i.astype("<u4").tobytes(), "tokens": n} for d, s, i, n in self.cut(units, pieces)]
                self.open.append((pos, parts, terms.astype("<u4").tobytes(), weight.astype("<i4").tobytes()))
            else:
                for few in powers(pieces):
                    self.emit(self.cut(units, few))

    def vectors(self, units: list, index: Shard, seed: int, own: slice) -> tuple[np.ndarray, np.ndarray]:
        return units[seed][1], units[seed][2]

    @staticmethod
    def cut(units: list, pieces: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """Parts that pieces (unit, from, to) consist of."""
        for j, a, b in pieces:
            for doc_id, start, ids, tokens in units[j][0]:
                lo, hi = max(a, 0), min(b, len(ids))
                if lo < hi:
                    yield doc_id, start + lo, ids[lo:hi], tokens
                a, b = a - len(ids), b - len(ids)

    def batch(self) -> pa.RecordBatch:
        own, far = list(zip(*self.pieces, strict=True)) or [()] * 7, list(zip(*self.open, strict=True)) or [()] * 4
        no, left = [None] * len(self.pieces), [None] * len(self.open)
        kinds = [pa.int64(), pa.list_(PART), pa.binary(), pa.binary()]
        columns = [pa.array([*c, *left], pa.int64()) for c in own] + [pa.array([*no, *c], t) for c, t in zip(far, kinds, strict=True)]
        self.pieces, self.open = [], []
        return pa.RecordBatch.from_arrays(columns, [*names(PIECES), *names(OPEN)])


class DocumentPacker(Packer):
    """The first level: rows of LED. Whole windows of a document leave at once; the rest is its unit, its whole text the query."""

    def __init__(self, window: int, local_docs: int, sent):
        super().__init__(1, window, local_docs)
        self.sent = sent

    def units(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, ids, width in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                ids = np.frombuffer(ids, f"<u{width}")
                n, whole = len(ids), len(ids) // self.window
                for k in range(whole):
                    self.emit([(doc_id, k * self.window, ids[k * self.window : (k + 1) * self.window], n)])
                yield [(doc_id, whole * self.window, ids[whole * self.window :], n)], ids, None

    def indexed(self, units: list) -> Shard:
        idf, mean = self.sent.value
        sizes = np.array([len(u[1]) for u in units])
        terms, tf, own = counted(np.concatenate([u[1].astype(np.int64) for u in units]), sizes)
        self.all = terms, weights(tf, idf[terms], np.repeat(sizes, own), mean)
        return Shard(*self.all, own)

    def vectors(self, units: list, index: Shard, seed: int, own: slice) -> tuple[np.ndarray, np.ndarray]:
        return self.all[0][own], self.all[1][own]


def pack_documents(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, seed: int = 11, local_docs: int = 512) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each token of each row lies in one of them.

    A document's tokens are the tokenizer's ids and one END. A null text is empty, one token; a null doc_id stays null.
    Rows that repeat are packed each. tokenizer is the path of a tokenizer file on all executors (None: the public one).
    Columns may have any names; doc_id and text alone are read. An empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), text), text.alias("text"))
    made = scratch.write(rows.mapInArrow(freeing(tokenized(tokenizer)), TOKENS), "tokens")
    n, mean, df = statistics(made)
    if not n:
        return spark.createDataFrame([], PIECES)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    sent, leading = (spark.sparkContext.broadcast((x, mean)) for x in (idf, np.where(df > 1, idf, 0.0)))
    rows = made.where(F.col("df").isNull()).drop("df")
    rows = scratch.write(rows.mapInArrow(freeing(led(leading)), LED), "led")
    scratch.drop("tokens")

    # a row number deals out rows that repeat, so that no key is larger than a shard
    keys = [*(F.col(f"lead{k + 1}") for k in range(LEADS)), F.xxhash64(F.lit(seed), "__id", "__t1"), F.col("__id"), F.col("__t1"), F.col("__m")]
    parts = max(spark.sparkContext.defaultParallelism, -(-n // 16384))
    rows = rows.withColumn("__m", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*names(LED))
    level = 1
    levels = [scratch.write(rows.mapInArrow(freeing(DocumentPacker(window, local_docs, sent)), LEVEL), "level-1")]
    while units := (left := levels[-1].where(F.col("pos").isNotNull()).select(*names(OPEN))).count():
        level += 1
        last = units <= 4 * local_docs
        parts = 1 if last else -(-units // (32 * local_docs))
        left = (left.coalesce(1) if last else left.repartitionByRange(parts, "pos")).sortWithinPartitions("pos")
        levels.append(scratch.write(left.mapInArrow(freeing(Packer(level, window, None if last else local_docs)), LEVEL), f"level-{level}"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.where(F.col("sequence_id").isNotNull()).select(*names(PIECES))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
