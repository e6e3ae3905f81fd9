"""WARC archives: a data source that writes gzip members of one record each, and reads them back in splits.

Reading: a task has a byte range of a file. It scans the range for the gzip magic, inflates the header of each candidate up
to its blank line and takes it for a record only if a WARC version line and header come out; the magic also turns up inside
compressed bytes. A task owns the members that start inside its range, with all records in them, and reads on past its end
for the last one. Compressed members of another archive that a payload holds are told from its own only by a reader that
comes from the file's start; read such archives with splits as large as the files.

Writing: each task writes a file of its own under a temporary name; the driver renames the files of the tasks whose
results count, so a lost executor or a second attempt leaves no half file and no second copy.

Paths go through pyarrow's file systems (local, HDFS, S3, GCS). Members are read one at a time, never a file at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from papyra.llm.common import Scratch, heavy_join, shared_root

MAGIC = b"\x1f\x8b\x08"
HEAD, STEP, MOST_HEAD = 4096, 1 << 20, 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One row for each record. refers_to is the id of the record that a revisit repeats; digests are bare lower-case hex.
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def member(row: dict) -> bytes:
    """One record as a gzip member. The block of a revisit is empty; its digest is that of the payload it repeats."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{quote(row['record_id'], safe=':/')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/octet-stream", f"Content-Length: {len(payload)}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=':/?#[]@!$&()*+,;=%~-._')}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{quote(row['refers_to'], safe=':/')}>"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + deflate.flush()


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name and the length of the header, or None if these bytes don't begin a record."""
    if not raw.startswith(b"WARC/1.") or (end := raw.find(b"\r\n\r\n")) < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id"} <= fields.keys() or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


class Member:
    """The decoded bytes of one gzip member, a MB at a time; `read` gives the next compressed bytes, b"" at the end."""

    def __init__(self, first: bytes, read):
        self.inflate, self.left, self.read = zlib.decompressobj(31), first, read
        self.held, self.fed, self.step = bytearray(), len(first), 64  # a little first: the header is read before damage behind it

    def more(self) -> bool:
        """Decodes some more; whether there was any. Raises zlib.error on damage, EOFError where the file ends too soon."""
        while not self.inflate.eof:
            if not self.left:
                self.left = self.read()
                if not self.left:
                    raise EOFError("the archive ends inside a record")
                self.fed += len(self.left)
            out = self.inflate.decompress(self.left, self.step)
            self.step = min(2 * self.step, STEP)
            self.left = self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def head(self) -> tuple[dict[str, str], int] | None:
        """The next record's fields and header length; None if no record begins here."""
        while True:
            if not b"WARC/1.".startswith(bytes(self.held[:7])):
                return None
            if (end := self.held.find(b"\r\n\r\n")) >= 0:
                return parse_head(bytes(self.held[: end + 4]))
            if len(self.held) > MOST_HEAD or not self.more():
                return None

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("a member ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_blank(self) -> bool:
        """Drops line ends; whether anything follows."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held or not self.more():
                return bool(self.held)

    @property
    def size(self) -> int:
        """Compressed bytes of the member, once it is decoded to its end."""
        return self.fed - len(self.inflate.unused_data)


def is_member(head: bytes, read=lambda: b"") -> bool:
    """Whether a gzip member whose first record has a whole header begins with these bytes; `read` gives those that follow."""
    try:
        return Member(head, read).head() is not None
    except (zlib.error, EOFError):
        return False


def record(fields: dict[str, str], block: bytes | None) -> tuple:
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    uri, refers = fields.get("warc-target-uri"), fields.get("warc-refers-to")
    return unquote(fields["warc-record-id"].strip("<>")), fields["warc-type"], uri and unquote(uri), refers and unquote(refers.strip("<>")), digest, block


def records(file, size: int, start: int, end: int, damaged: str = "raise") -> Iterator[tuple]:
    """The records of the members that start in [start, end), all of each member.

    A candidate counts once its first header is decoded to the blank line. Damage after its version line, or a file that ends before the
    record does, raises ValueError; with damaged="report" it gives a row of type `damaged` in place of what could not be
    read, with the fields of the header, and the scan goes on behind the magic.
    """
    at, window, base = start, b"", start

    def following(place: int):
        def read() -> bytes:
            nonlocal place
            chunk = file.read_at(STEP, place) if place < size else b""
            place += len(chunk)
            return chunk

        return read

    while at < end:
        if at - base + HEAD > len(window) and base + len(window) < size:
            window, base = file.read_at(STEP + HEAD, at), at
        found = window.find(MAGIC, at - base)
        if found < 0:
            at = base + len(window) - len(MAGIC) + 1 if base + len(window) < size else end
            continue
        at = base + found
        if at >= end:
            return
        body = Member(window[found:], following(base + len(window)))
        fields = {"warc-record-id": "", "warc-type": ""}
        try:
            head = body.head()
            if head is None:  # the magic by chance, within compressed bytes
                at += 1
                continue
            while head is not None:
                fields, length = head
                body.take(length)
                block = body.take(int(fields["content-length"]))
                head = None
                more = body.skip_blank()
                yield record(fields, block)
                if more and (head := body.head()) is None:
                    raise zlib.error("bytes that are no record follow a record")
            at += body.size
        except (zlib.error, EOFError) as e:
            if not body.held.startswith(b"WARC/1.") and not fields["warc-type"]:
                at += 1
                continue
            if damaged != "report":
                raise ValueError(f"damaged record in the member at byte {at}: {e}") from e
            yield (*record(fields, None)[:1], "damaged", *record(fields, None)[2:])
            at += 1


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, damaged: str):
        if damaged not in ("raise", "report"):
            raise ValueError("damaged is raise or report")
        self.path, self.split_bytes, self.damaged = path, split_bytes, damaged

    def partitions(self) -> list[Range]:
        system, path = file_system(self.path)
        found = [x for x in system.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and x.base_name.endswith(".warc.gz")]
        return [Range(x.path, x.size, a, min(x.size, a + self.split_bytes)) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.split_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        names, schema = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload"], [pa.string()] * 5 + [pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names)
        with file_system(self.path)[0].open_input_file(partition.path) as file:
            rows, held = [], 0
            for row in records(file, partition.size, partition.start, partition.end, self.damaged):
                rows.append(row)
                held += len(row[-1] or b"")
                if held > 8 << 20 or len(rows) >= 4096:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        temporary, final = f"{path}/.part-{part:05d}-{uuid.uuid4().hex}.tmp", f"{path}/part-{part:05d}.warc.gz"
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        out.write(member(row))
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class WarcSource(DataSource):
    """format("warc"): load(folder) with options splitBytes (64 MB) and damaged (raise, or report), or mode("append").save(folder) of rows in SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), self.options.get("damaged", "raise"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_archives(rows: DataFrame, path: str, key: str, payload: str, uri: str, least_bytes: int = 100) -> None:
    """Writes a record for each row, its payload as UTF-8; equal payloads of least_bytes or more are revisits of that of the smallest key.

    Rows whose key is null come after all others. Rows that repeat a key with the same payload: the first by URI is the
    response, if its key is the smallest. Null payloads are empty. Only digests of rows are grouped; which digest repeats
    comes back by a join whose skewed side Spark splits, so a payload that a third of all rows hold meets no single task.
    """
    spark = rows.sparkSession
    spark.dataSource.register(WarcSource)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = rows.select(F.col(key).cast("long").alias("k"), F.col(uri).cast("string").alias("u"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("k").isNull().alias("no_key"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("u", F.lit("")).alias("u"))
    counted = rows.where(F.octet_length("payload") >= least_bytes).select("digest", order.alias("o"))
    twice = counted.groupBy("digest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "first")
    joined = rows.join(twice.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & (order != F.col("first"))
    name = lambda k, u, none: F.concat_ws(":", F.lit("urn:row"), F.when(none, "").otherwise(k.cast("string")), "digest", u)
    out = joined.select(
        name(F.col("k"), F.coalesce("u", F.lit("")), F.col("k").isNull()).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("u").alias("target_uri"),
        F.when(revisit, name(F.col("first.k"), F.col("first.u"), F.col("first.no_key"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = 64 << 20, damaged: str = "raise") -> DataFrame:
    """All records below path: rows in SCHEMA. What is damaged raises, or with damaged="report" is a row of that type."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", str(split_bytes)).option("damaged", damaged).load(path)


def resolved(records: DataFrame) -> DataFrame:
    """Adds payload_bytes and digest of the full payload: computed from the stored bytes, for revisits from those of the record they name.

    A revisit whose record is not there has null for both. The archives are read once, for a table without payloads; only
    revisits are joined, those of a record that more than a thousandth of them name by broadcast.
    """
    scratch = Scratch(records.sparkSession, "warc-records")
    heads = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest"]
    rows = scratch.write(records.select(*heads, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest")), "records")
    revisit = F.col("record_type") == "revisit"
    named = rows.where(~revisit).groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("digest").alias("digest"))
    joined = heavy_join(rows.where(revisit).select(*heads), named, ["refers_to"])
    return rows.where(~revisit).unionByName(joined.select(*rows.columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, "page_id", "html", "url")
    rows = resolved(read_archives(spark, path))
    number = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
