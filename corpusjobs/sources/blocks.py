"""A data source of blocks of lines that blank lines part, as CoNLL files have: splits of any size, and a writer that commits.

A file is cut into ranges of bytes; a range gives the blocks that begin in it, each whole. Lines may end in LF or CRLF,
each file for itself, and lines of white space are blank. Files are read and written through pyarrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, sent_id bigint, lines array<string>"
SPLIT_BYTES, BATCH, FILE_BITS = 64 << 20, 1000, 20


def file_system(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of all files below a folder but hidden ones, in order."""
    from pyarrow import fs

    system, base = file_system(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    hidden = lambda name: any(p[:1] in "._" for p in name[len(base) :].split("/") if p)
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not hidden(x.path))


@dataclass
class Range(InputPartition):
    """Bytes of a file, whose blocks' ids begin with the file's number."""

    file: str
    number: int
    start: int
    end: int


def blocks_in(file, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """Place and lines of the blocks that begin in [start, end) of an open file."""
    at = 0
    if start:
        file.seek(start - 1)
        file.readline()  # the line around the cut
        at = file.tell()
        blank = not _line_before(file, at).strip()
        file.seek(at)
        while not blank:  # the rest of a block of the range before
            line = file.readline()
            if not line:
                return
            at, blank = at + len(line), not line.strip()
    begun, lines = at, []
    while True:
        line = file.readline()
        if line.strip():
            if not lines:
                begun = at
                if begun >= end:
                    return
            lines.append(line.rstrip(b"\r\n").decode())
        elif lines:
            yield begun, lines
            lines = []
        at += len(line)
        if not line or not lines and at >= end:
            return


def _line_before(file, at: int) -> bytes:
    """The line that ends at a place where another begins."""
    size = 4096
    while True:
        low = max(0, at - size)
        file.seek(low)
        lines = file.read(at - low).splitlines(keepends=True)
        if len(lines) > 1 or not low:
            return lines[-1] if lines else b""
        size *= 4


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(name, k, lo, min(lo + self.split, size)) for k, (name, size) in enumerate(files_of(self.path)) for lo in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        held: list[tuple[int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            ids = [partition.number << (63 - FILE_BITS) | at for at, _ in held]
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(held)), pa.array(ids, pa.int64()), pa.array([x for _, x in held], pa.list_(pa.string()))], ["file", "sent_id", "lines"])

        with system.open_input_file(partition.file) as raw:
            import io

            for block in blocks_in(io.BufferedReader(raw, 1 << 20), partition.start, partition.end):
                held.append(block)
                if len(held) >= BATCH:
                    yield batch()
                    held = []
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str


class BlockWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; the commit gives files that succeeded their names, an abort takes them away."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.end, self.overwrite = options["path"], options.get("lineend", "\n"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        name = f".part-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in iterator:
                for lines in batch.column(batch.schema.get_field_index("lines")).to_pylist():
                    if lines:
                        out.write((self.end.join([*lines, "", ""])).encode())
        return Written(name)

    def commit(self, messages: list) -> None:
        system, base = file_system(self.path)
        if self.overwrite:
            for name, _ in files_of(self.path):
                system.delete_file(name)
        for k, m in enumerate(m for m in messages if m is not None):
            system.move(f"{base}/{m.file}", f"{base}/part-{k:05d}-{m.file[6:]}")
        system.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        system, base = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{base}/{m.file}")


class BlockSource(DataSource):
    """Format 'blocks': file, sent_id (ascending in files' order, then by place) and lines. Options: path, splitBytes, lineEnd."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)
