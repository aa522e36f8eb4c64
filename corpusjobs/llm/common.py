"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Made(threading.local):
    """Lists of the folders that a thread named while they were open, see passing()."""

    def __init__(self):
        self.lists: list[list[str]] = []


_MADE = _Made()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent on a local master (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusjobs-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for own in _MADE.lists:
        own.append(path)
    return path


@contextmanager
def passing() -> Iterator[None]:
    """Deletes at its end what this thread wrote to shared folders in it: only for work whose results are written elsewhere."""
    own: list[str] = []
    _MADE.lists.append(own)
    try:
        yield
    finally:
        _MADE.lists = [x for x in _MADE.lists if x is not own]
        for path in own:
            fs, base = fs_of(path)
            if fs.get_file_info(base).type.name == "Directory":
                fs.delete_dir(base)


#: Bytes of a row group of large rows.
LARGE_ROWS = 4 << 20


def table_of(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives a lost executor.

    large: rows take megabytes each. Parquet's writer asks only after a hundred rows whether its buffer is full, and its
    reader holds up to 4,096 rows of a row group, so such rows get row groups of a few.
    """
    path = shared_dir(df.sparkSession, name)
    out = df.write.options(**{"parquet.block.size": LARGE_ROWS, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}) if large else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker remembers from one task to the next, by operator.
REMEMBERED: dict[str, dict] = {}


def give_back(owner: str | None = None) -> None:
    """Frees what operators besides the owner remembered, and memory that the allocators hold."""
    for other in REMEMBERED.keys() - {owner} if owner is not None else ():
        del REMEMBERED[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(task: Callable, owner: str = "") -> Callable:
    """A function for mapInArrow in a worker that other operators' tasks have used before.

    It first forgets what they remembered, and gives freed memory back before and after, since workers are reused
    and an executor's memory has to hold all of theirs at once.
    """

    def run(batches):
        give_back(owner)
        yield from task(batches)
        give_back()

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents outside the held-out fold, lowest hash of the id first.

    Labels of one doc_id are averaged and rounded up from a half. The chosen ids are bounded by `most`, so they
    are broadcast; documents are only scanned. Of rows that share an id, the one with the least hash of its text counts.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
    own = own.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in map(str.lower, columns):
        name = "_" + name
    return name


def with_text(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a string column that holds text: its own, or one more where that has another type."""
    if dict(docs.dtypes)["text"] == "string":
        return docs, "text"
    name = unused("__text", docs.columns)
    return docs.withColumn(name, F.col("text").cast("string")), name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, most: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key and, in rows, how many of left's rows have it.

    Keys with more than one in `most` of all those rows, which are fewer than `most`, are broadcast with what right
    tells of them, so none lands in one task whole; the others are shuffled.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = right.filter(F.col(rows) * most > total)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(rows) * most <= total), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def with_schema(columns: str, df: DataFrame) -> str:
    """DDL of columns, each 'name type'; a name ending in * takes the type it has in df."""
    types = dict(df.dtypes)
    return ", ".join(f"`{c[:-1]}` {types[c[:-1]]}" if c.endswith("*") else c for c in columns.split(", "))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def fs_of(uri: str):
    """A pyarrow file system and the path in it; a bare path is a local one."""
    from pyarrow import fs

    if re.match(r"^file:/", uri):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


#: Bytes of text that a task works on at once: its arrays take some hundred bytes for each.
PIECE = 1 << 19


def pieces(data: np.ndarray, off: np.ndarray, most: int = PIECE, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about most bytes (one row at least, `rows` at most): first row, last row, bytes, offsets in them."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + rows if rows else n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that stand in words parted by ASCII white space, and in words of letters, digits and non-ASCII.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
LETTER_WORDS = np.zeros(256, bool)
LETTER_WORDS[48:58] = LETTER_WORDS[97:123] = LETTER_WORDS[128:] = True

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of the rows of a piece after lower-casing A-Z: 64-bit hash h of each (made when asked for), its row, its start and end byte."""

    def __init__(self, data: np.ndarray, off: np.ndarray, in_word: np.ndarray):
        low = _LOWER[data]
        w = in_word[low]
        before, after = np.empty_like(w), np.empty_like(w)
        if len(w):
            before[0], before[1:], after[-1], after[:-1] = False, w[:-1], False, w[1:]
            inner = off[1:-1]
            before[inner[inner < len(w)]] = False
            after[inner[inner > 0] - 1] = False
        self.start, self.end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self._low = low

    @cached_property
    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on as a number, the first one lowest; zeros follow the last byte."""
        padded = np.concatenate([self._low, np.zeros(8, np.uint8)])
        return np.ndarray(len(self._low) + 1, "<u8", padded, strides=(1,))

    @cached_property
    def h(self) -> np.ndarray:
        return self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end, equal for equal bytes wherever they stand.

        Each eight bytes are scattered by themselves, with their place and the length, before they are summed. So words of
        eight bytes or fewer that differ have different hashes, and others equal ones with a chance of about 1 in 2**64.
        """
        size = end - start
        n = np.maximum(1, (size + 7) >> 3)
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        eight = self._eights[np.repeat(start, n) + 8 * k]
        over = np.maximum(0, 8 * (k + 1) - np.repeat(size, n))  # bytes beyond the end, 8 at most
        eight = np.where(over < 8, eight & (_ALL >> (over.astype(np.uint64) * np.uint64(8) % np.uint64(64))), np.uint64(0))
        terms = mix(eight ^ mix(k.astype(np.uint64) + np.uint64(1)))
        return mix((np.add.reduceat(terms, first) if len(first) else terms) + size.astype(np.uint64))

    def bounds(self, rows: int) -> np.ndarray:
        """The first word of each row and, last, the number of words."""
        return np.searchsorted(self.row, np.arange(rows + 1))
