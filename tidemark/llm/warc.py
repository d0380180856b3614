"""WARC archives as a chunked record table.

An archive is a Parquet table of (serial, record_id, chunk_no, n_chunks, data)
rows in a shared folder: the bytes of one WARC/1.1 record (header lines, blank
line, payload, two line ends) cut into chunks of ``chunk_bytes``. The serial
tells the records of an archive apart and is the record's WARC-Record-ID; ids
may repeat or be null. Writing streams a payload chunk by chunk with an
incremental SHA-1; reading carries the digest from chunk to chunk. What a task
holds whole is one row as Spark hands it over, in an Arrow batch; no side joins
a record's chunks again. Records of a single chunk are read where they lie; only
the chunks of oversized records are brought together, by serial and in chunk order.

A payload that some record with a smaller id already has is not stored: its
record is a ``revisit`` that refers to the smallest such id. Payloads under
``least_bytes`` are always stored.

Defined cases: a null payload is empty; every row is a record, also where an id
repeats; a row without an id is never referred to, and revisits the smallest id
with its payload where there is one; a URL is percent-encoded, so that any
characters and any length come back, and a null URL comes back null; an empty
table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 64 << 10
CHUNKS = "serial long, record_id long, chunk_no int, n_chunks int, data binary"
RECORD = "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Characters of a URL that need no encoding.
PLAIN = "!#$&'()*+,/:;=?@[]~"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def header(serial: int, record_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The header of a response record, or of a revisit where ``refers_to`` is given."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:tidemark:{serial}>"]
    if record_id is not None:
        lines.append(f"X-Page-ID: {record_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=PLAIN, errors='surrogatepass')}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {size if refers_to is None else 0}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def digests(pages: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, sha1): sizes and hexadecimal digests of the full payloads."""
    return pages.select("record_id", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("payload_bytes"), F.sha1(F.coalesce("payload", F.lit("").cast("binary"))).alias("sha1"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write ``pages`` (record_id, url, payload as binary) as an archive at ``path``."""
    if chunk_bytes < 64:
        raise ValueError("chunks of 64 bytes or more")
    seen = digests(pages).where(F.col("payload_bytes") >= least_bytes)
    first = seen.groupBy("sha1").agg(F.min("record_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = seen.join(first, "sha1").where("record_id is null or record_id <> refers_to").select(F.col("record_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to").distinct()
    again = common.scratch(again, "revisits")
    marked = pages.withColumn("sha1", F.sha1(F.coalesce("payload", F.lit("").cast("binary"))))
    same = F.col("record_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1"))
    marked = marked.join(common.with_broadcast_if_small(again, 100_000), same, "left").select("record_id", "url", "payload", "refers_to")

    kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), ["serial", "record_id", "chunk_no", "n_chunks", "data"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, rows, held = TaskContext.get().partitionId() << 36, [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for record, url, payload, refers in zip(*batch.columns):
                view = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                sha = hashlib.sha1()
                for k in range(0, len(view), chunk_bytes):
                    sha.update(view[k : k + chunk_bytes])
                record, refers = record.as_py(), refers.as_py()
                start = header(serial, record, url.as_py(), len(view), base32_sha1(sha.hexdigest()), refers)
                body = len(view) if refers is None else 0
                total = len(start) + body + 4
                n = -(-total // chunk_bytes)
                for k in range(n):
                    a, b = k * chunk_bytes, min((k + 1) * chunk_bytes, total)
                    data = start[a:b] + bytes(view[max(0, a - len(start)) : max(0, min(b - len(start), body))])
                    rows.append((serial, record, k, n, data + b"\r\n\r\n"[max(0, 4 - (total - a)) : 4][: b - a - len(data)]))
                    held += len(data)
                    if held > common.SLICE_BYTES:
                        yield out()
                        held = 0
                serial += 1
        yield out()

    common.write(marked.mapInArrow(task, CHUNKS), path)


class _Reader:
    """One record in the course of being read: its header, and the digest and size of the payload so far."""

    def __init__(self, serial: int):
        self.serial, self.head, self.fields = serial, bytearray(), None
        self.sha, self.size, self.left = hashlib.sha1(), 0, 0

    def add(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n", max(0, len(self.head) - len(data) - 3))
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            lines = self.head[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"record {self.serial} has no WARC header")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"])
        part = data[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)

    def row(self) -> tuple:
        if self.fields is None:
            raise ValueError(f"record {self.serial} is cut off")
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if self.left or kind == "response" and (base64.b32encode(self.sha.digest()).decode() != digest or self.size != int(self.fields["X-Payload-Length"])):
            raise ValueError(f"record {self.serial} is damaged")
        page, url, refers = (self.fields.get(k) for k in ("X-Page-ID", "WARC-Target-URI", "X-Refers-To-Page"))
        return int(page) if page else None, unquote(url, errors="surrogatepass") if url is not None else None, int(self.fields["X-Payload-Length"]), digest, kind, int(refers) if refers else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record, its payload checked against its digest."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, 0
        for batch in batches:
            rows = []
            for serial, chunk, n, data in zip(*(batch.column(c) for c in ("serial", "chunk_no", "n_chunks", "data"))):
                serial, chunk = serial.as_py(), chunk.as_py()
                if chunk == 0:
                    now, due = _Reader(serial), 0
                if now is None or now.serial != serial or chunk != due:
                    raise ValueError(f"record {serial} lacks a chunk")
                now.add(data.as_py())
                due += 1
                if due == n.as_py():
                    rows.append(now.row())
                    now = None
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    chunks = spark.read.schema(CHUNKS).parquet(path)
    single = chunks.where("n_chunks = 1").mapInArrow(task, RECORD)
    large = chunks.where("n_chunks > 1").repartition("serial").sortWithinPartitions("serial", "chunk_no")
    return single.unionByName(large.mapInArrow(task, RECORD))


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all rows of ``pages`` as an archive in the shared folder and read it back."""
    source = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    path = common.scratch_path(pages.sparkSession, "warc")
    write(source, path, least_bytes, chunk_bytes)
    return read(pages.sparkSession, path)
