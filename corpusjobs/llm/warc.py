"""Operator 5: WARC archives, written and read back one gzip member per record.

Writer: each task writes one archive in the shared folder under a passing name and renames it when whole.
Reader: sequential, in bounded memory: chunks are inflated as they come, a member's end is a record's end, the
block is framed by Content-Length, and block and payload digests are verified while it streams by.

Of records with equal payloads of at least `min_bytes`, the one with the smallest page_id is a response and the
others are revisits of it, with the profile for identical payload digests. A digest that very many pages share is
joined by broadcast.

Defined cases: a null html is an empty payload; a null url is empty; a null page_id is never a smallest one
unless all are null, which makes all of them responses; a very long payload is written and read in parts; repeated rows
with the smallest page_id are all responses; an empty table writes no archive; columns besides page_id, url and html
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fs_of, join_hot, lean, shared_dir, table, table_of

MIN_BYTES, CHUNK = 100, 1 << 16
URN = "<urn:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {URN.format('null' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: {URN.format(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _id(urn: str):
    text = urn[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


def _fields(head: bytes) -> dict[str, str]:
    return dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:]))


class _Record:
    """A record that arrives in parts: header, then the block by its length, then the closing line ends."""

    def __init__(self):
        self.start, self.head, self.http = b"", None, None

    def feed(self, data: bytes) -> None:
        if self.head is None:
            self.start += data
            head, found, data = self.start.partition(b"\r\n\r\n")
            if not found:
                return
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record at the start of a member")
            self.head, self.left, self.tail = _fields(head), int(_fields(head)["content-length"]), b""
            self.block, self.payload, self.start, self.size = hashlib.sha256(), hashlib.sha256(), b"", 0
        mine, rest = data[: self.left], data[self.left :]
        self.left -= len(mine)
        self.tail += rest
        self.block.update(mine)
        if self.http is None:
            self.start += mine
            http, found, mine = self.start.partition(b"\r\n\r\n")
            if not found:
                return
            self.http = _fields(http)
        self.payload.update(mine)
        self.size += len(mine)

    def row(self) -> tuple:
        if self.head is None or self.http is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        digest, kind = self.head["warc-payload-digest"].removeprefix("sha256:"), self.head["warc-type"]
        if self.block.hexdigest() != self.head["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError("a block digest does not match")
        if kind == "response" and (self.payload.hexdigest() != digest or self.size != int(self.http["content-length"])):
            raise ValueError("a payload digest does not match")
        refers = self.head.get("warc-refers-to")
        return _id(self.head["warc-record-id"]), int(self.http["content-length"]), digest, kind, _id(refers) if refers else None


def read_archive(stream) -> Iterator[tuple]:
    """Rows of an archive, in its order; stream has read(n)."""
    data = stream.read(CHUNK)
    while data:
        z, rec = zlib.decompressobj(31), _Record()
        while True:
            rec.feed(z.decompress(data, CHUNK))
            if z.eof:
                break
            data = z.unconsumed_tail or stream.read(CHUNK)
            if not data:
                raise ValueError("the last member is cut off")
        yield rec.row()
        data = z.unused_data or stream.read(CHUNK)


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the rows that repeat the payload of a smaller page_id."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    ids = pages.select("page_id", F.sha2(raw, 256).alias("digest"), F.length(raw).alias("n")).filter(F.col("n") >= min_bytes)
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1 and refers_to is not null")
    return join_hot(ids.drop("n"), first, "digest", "rows").filter("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes an archive per task below folder; the manifest: file, n_records, n_bytes."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), raw.alias("payload"), F.sha2(raw, 256).alias("digest"))
    rows = rows.join(again, F.expr("page_id <=> p and digest = d"), "left").select("page_id", "url", "payload", "refers_to")

    def write(batches):
        fs, base = fs_of(folder)
        out, n, size = None, 0, 0
        name = f"pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"  # the manifest tells which attempt counts
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    passing = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(passing, compression=None)
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(passing, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])

    return table_of(rows.mapInArrow(lean(write), "file string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches):
        fs, base = fs_of(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, got = [], 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        got += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if got != n:
                    raise ValueError(f"{file} has {got} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "n_records").repartition(parts).mapInArrow(lean(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)
