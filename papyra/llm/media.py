"""Media columns: interleaved sequences of text and media, with payloads kept by digest.

parse_html() turns a page into ordered items: a text, or a reference to media with its caption. A media table has a row for
each digest of what it holds; resolve() joins references with it by digest, so captions and positions stay with their
reference and no payload is copied into pages. Payloads are written where they are made, and each task encodes, writes and
decodes a payload once, however many of its rows have it; only digests, captions and small columns are shuffled. A payload
that very many pages use is joined by broadcast of its few small columns.

8-bit samples are stored as PNG: rows of 64 RGB pixels, 192 samples each, lossless.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import Scratch, free_name, heavy_join, row_key

ROW = 192
PNG = b"\x89PNG\r\n\x1a\n"
#: Elements whose text is not shown, that end a run of text, that a head or a caption may hold, and that stand for media.
HIDDEN = {"script", "style", "template", "noscript", "head", "title"}
BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "table", "tr", "td", "th", "pre", "blockquote", "nav", "footer", "header", "main", "aside", "hr", "body", "html"}
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "template", "noscript"}
IN_CAPTION = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "td", "th", "hr"}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


class _Items(HTMLParser):
    """Collects items. A hidden element ends with its own end tag, a head also with what no head may hold, and a caption with
    its figure or with a block, so that an end tag that HTML lets one leave out hides nothing of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[dict] = []  # open figures: the first of their items, and their caption
        self.caption: list[str] | None = None

    def _end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def _end_caption(self) -> None:
        text = " ".join("".join(self.caption or []).split())
        self.caption = None
        if self.figures and text:
            self.figures[-1]["caption"] = text
        elif text:  # a caption of no figure is text
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def _end_figure(self) -> None:
        if self.caption is not None:
            self._end_caption()
        figure = self.figures.pop()
        for item in self.items[figure["first"] :]:
            if item["kind"] != "text" and not item.get("own"):
                item["own"] = True  # the innermost figure's caption holds
                item["caption"] = figure["caption"] or item["caption"]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden and self.hidden[-1] == "head" and tag not in IN_HEAD:
            self.hidden.pop()
        if tag in HIDDEN:
            self.hidden.append(tag)
            return
        if self.hidden:
            return
        if self.caption is not None and (tag in BLOCK - {"br"} or tag == "figcaption") and tag not in IN_CAPTION:
            self._end_caption()
        if tag in BLOCK or tag == "figcaption":
            self._end_run()
        if tag == "figure":
            self.figures.append({"first": len(self.items), "caption": None})
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            attrs = dict(attrs)
            if attrs.get("src"):
                self._end_run()
                self.items.append({"kind": MEDIA[tag], "text": None, "ref": attrs["src"], "caption": attrs.get("alt") or None})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
            return
        if tag == "figcaption" and self.caption is not None:
            self._end_caption()
        elif tag in BLOCK:
            self._end_run()
        if tag == "figure" and self.figures:
            self._end_figure()

    def handle_data(self, data: str) -> None:
        if self.hidden and self.hidden[-1] == "head" and data.strip():
            self.hidden.pop()
        if self.hidden:
            return
        (self.run if self.caption is None else self.caption).append(data)

    def end(self) -> list[dict]:
        self._end_run()
        if self.caption is not None and not self.figures:
            self._end_caption()
        while self.figures:
            self._end_figure()
        return [{"position": i, **{k: item[k] for k in ("kind", "text", "ref", "caption")}} for i, item in enumerate(self.items)]


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page. A caption is the figcaption of the innermost figure around it, before or behind, else the alt text.

    End tags may be missing and stray ones do nothing; script, style, template, noscript, title and head are not shown. Null: none.
    """
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    return parser.end()


def interleave(pages: DataFrame, html: Column, into: str = "items") -> DataFrame:
    """Adds the array of items of each page as column `into`; a taken name raises. Rows, repeats and other columns stay."""
    free_name(pages, into)

    @F.pandas_udf(ITEMS)
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(parse_html)

    return pages.withColumn(into, items(html))


def resolve(references: DataFrame, media: DataFrame, digest: str = "digest") -> DataFrame:
    """Left join by digest with a media table that has a row for each digest; references without payload keep nulls.

    A column that both have, but for the digest, raises. Give written tables: both are read more than once.
    """
    if both := {*references.columns} & {*media.columns} - {digest}:
        raise ValueError(f"columns of both tables: {sorted(both)}")
    return heavy_join(references, media, [digest])


def to_png(samples: bytes) -> bytes:
    """An RGB image 64 pixels wide; samples must fill whole rows."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # filter 0 at the head of each row
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of an image that to_png() wrote, one row of the array each; checks signature, checksums and filters."""
    if not data.startswith(PNG):
        raise ValueError("no PNG signature")
    at, body, size = len(PNG), [], (0, 0)
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", part)
            if (depth, colour) != (8, 2):
                raise ValueError("8-bit RGB alone is read")
            size = (height, width * 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(size[0], size[1] + 1)
    if raw[:, 0].any():
        raise ValueError("filter 0 alone is read")
    return raw[:, 1:]


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes and their number before spaces fill them up to a positive multiple of ROW."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % ROW if data else ROW)


def feature(samples: np.ndarray) -> str:
    """Size, mean of each channel, and 64 bits that say which of 8 x 8 parts are brighter than their mean."""
    pixels = samples.reshape(len(samples), -1, 3)
    means = pixels.mean(axis=(0, 1), dtype=np.float64)
    rows = np.minimum(np.arange(len(samples)) * 8 // len(samples), 7)
    bright = pixels.sum(axis=2, dtype=np.int64).reshape(len(samples), 8, -1).sum(axis=2)
    total, count = np.zeros((8, 8)), np.bincount(rows, minlength=8)[:, None]
    np.add.at(total, rows, bright)
    grid = total / np.maximum(count, 1)
    bits = "".join("1" if x else "0" for x in (grid > grid[count[:, 0] > 0].mean()).ravel())
    return f"{pixels.shape[1]}x{pixels.shape[0]};rgb={means[0]:.3f},{means[1]:.3f},{means[2]:.3f};hash={int(bits, 2):016x}"


class Seen(set):
    """The last digests that a task has met, MOST at most."""

    MOST = 1 << 16

    def new(self, digest: str) -> bool:
        if digest in self:
            return False
        if len(self) >= self.MOST:
            self.clear()
        self.add(digest)
        return True


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, __id, __t1, text) to (.., n_bytes, digest, media), a few MB at a time; media is null where the task has stored it."""
    names = ["doc_id", "__id", "__t1", "n_bytes", "digest", "media"]

    def out(batch, lo, rows):
        part = batch.slice(lo, len(rows))
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True))], names)

    seen = Seen()
    for batch in batches:
        lo, rows, held = 0, [], 0
        for text in batch.column(3):
            n, payload = padded(text.as_py())
            digest = hashlib.sha256(payload).hexdigest()
            rows.append((n, digest, to_png(payload) if seen.new(digest) else None))
            held += len(rows[-1][2] or b"")
            if held > 4 << 20:
                yield out(batch, lo, rows)
                lo, rows, held = lo + len(rows), [], 0
        if rows:
            yield out(batch, lo, rows)


MEDIA_ROWS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, media) to MEDIA_ROWS, all from the stored bytes; a digest that the task has met gives no second row."""
    seen = Seen()
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0), batch.column(1), strict=True):
            if not seen.new(digest.as_py()):
                continue
            data = media.as_py()
            samples = from_png(data)
            payload = samples.tobytes()
            rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
        kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in MEDIA_ROWS.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in MEDIA_ROWS.split(", ")])


def media_of_documents(docs: DataFrame) -> DataFrame:
    """Stores each text as an image, builds a page that shows it with a caption, and resolves the page's references.

    Rows (doc_id, n_bytes, position, caption, and MEDIA_ROWS without digest), one for each row of docs, repeats included.
    Null text is empty: one row of spaces. Equal texts have equal values. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "media")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), text), text.alias("text"))
    media = scratch.write(rows.mapInArrow(stored, "doc_id long, __id long, __t1 long, n_bytes long, digest string, media binary"), "store")
    page = F.format_string('<article><figure><img src="sha256:%s" alt="document"><figcaption>%d bytes</figcaption></figure></article>', "digest", "n_bytes")
    pages = interleave(media.select("doc_id", "n_bytes", page.alias("html")), F.col("html"))
    shown = pages.select("doc_id", "n_bytes", F.explode("items").alias("item")).where(F.col("item.kind") == "image")
    shown = shown.select("doc_id", "n_bytes", F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.regexp_replace("item.ref", "^sha256:", "").alias("digest"))
    shown = scratch.write(shown, "references")
    values = media.where(F.col("media").isNotNull()).select("digest", "media").mapInArrow(described, MEDIA_ROWS)
    values = values.groupBy("digest").agg(*[F.first(c).alias(c) for c in (f.split()[0] for f in MEDIA_ROWS.split(", ")[1:])])
    return resolve(shown, scratch.write(values, "values")).drop("digest")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
