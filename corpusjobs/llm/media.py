"""Operator 3: media columns over content-addressed payloads in tar shards.

Every task streams its payloads into tar shards of its own in the shared folder, one member per different
payload, named by its SHA-256; a copy met again in the task points to the member that is there. Rows of the
catalog carry digest, shard, offset and length. Metadata columns come from range reads of the 33 header bytes;
features from range reads of a whole member. A shard is written under a passing name and renamed when whole,
so a task that runs again replaces it by the same bytes. Payloads are never shuffled, only catalog rows.

The media format is an 8-bit grey PNG of width 64: a text's UTF-8 bytes with bytes 0 appended up to a positive
multiple of 64 are its samples, row by row, without filters.

Defined cases: a null text is empty and gives one row of 64 zero samples; repeated rows and equal texts have
equal values; a very long text is one member; a null doc_id is kept; an empty table gives no rows; columns besides
doc_id and text are not read, whatever their names. A payload that several tasks meet has a member in each one's
shards; canonical() tells one place of each digest.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fs_of, lean, shared_dir, table, table_of

WIDTH, SHARD_BYTES, HEADER = 64, 256 << 20, 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def encode(payload: bytes) -> bytes:
    """PNG of the payload, whose length is a multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("not the header of a PNG")
    return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big"), head[24]


def decode(media: bytes) -> bytes:
    """The payload of a PNG that encode() made; every chunk's checksum is verified."""
    width, height, _ = header_of(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        n, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk of a PNG is damaged")
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered PNG")
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, and the share of each sixteenth of their range."""
    a = np.frombuffer(payload, np.uint8)
    share = np.bincount(a >> 4, minlength=16) / len(a)
    return f"mean={a.mean():.4f};std={a.std():.4f};hist=" + ",".join(f"{x:.5f}" for x in share)


class ShardWriter:
    def __init__(self, folder: str, task: int, attempt: int = 0):
        self.attempt = attempt  # a task that runs again names its shards anew; the catalog tells which count
        self.fs, self.folder = fs_of(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.task, self.number, self.out, self.seen = task, -1, None, {}

    def put(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if digest in self.seen:
            return self.seen[digest]
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.number, self.at = self.number + 1, 0
            self.name = f"shard-{self.task:06d}-{self.attempt}-{self.number:04d}.tar"
            self.passing = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.passing)
        media = encode(payload)
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        place = self.seen[digest] = (self.name, self.at + len(head), len(media))
        self.at += len(head) + len(media) + (-len(media) % 512)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(self.passing, f"{self.folder}/{self.name}")
            self.out, self.seen = None, {}


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards below folder; the catalog: doc_id, n_bytes, digest, shard, offset, length."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches):
        writer = ShardWriter(folder, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(raw), digest, *writer.put(digest, payload)))
            n, digest, shard, offset, length = map(list, zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return table_of(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(write), f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long"), "catalog")


def canonical(catalog: DataFrame) -> DataFrame:
    """One place of each digest over all shards: digest, shard, offset, length, n_rows."""
    return catalog.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").alias("n_rows")).select("digest", "p.shard", "p.offset", "p.length", "n_rows")


def media_columns(catalog: DataFrame, folder: str, features: bool = True) -> DataFrame:
    """The catalog with width, height and bit_depth by header-only range reads; with features, whole members are read too."""
    wide = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = f"doc_id {dict(catalog.dtypes)['doc_id']}, n_bytes long, digest string, shard string, offset long, length long, width int, height int, bit_depth int" + f", {wide}" * features

    def read(batches):
        fs, base = fs_of(folder)
        name, file, known = None, None, {}
        for batch in batches:
            out = []
            for shard, offset, length, digest in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 2))):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file, known = shard, fs.open_input_file(f"{base}/{shard}"), {}
                if offset not in known:
                    row = header_of(file.read_at(HEADER, offset))
                    if features:
                        media = file.read_at(length, offset)
                        payload = decode(media)
                        got = hashlib.sha256(payload).hexdigest()
                        if got != digest:
                            raise ValueError(f"{shard} at {offset} isn't {digest}")
                        row += (len(payload), got, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                    known[offset] = row
                out.append(known[offset])
            kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] * features
            new = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            names = ["width", "height", "bit_depth"] + ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] * features
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
        if file is not None:
            file.close()

    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = catalog.repartitionByRange(parts, "shard", "offset", "doc_id").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(lean(read), schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "shards")
    return media_columns(store(table(spark, sf_dir, "documents"), folder), folder).drop("digest", "shard", "offset", "length")
