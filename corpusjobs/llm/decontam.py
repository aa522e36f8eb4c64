"""Operator 2: benchmark decontamination with an FM-index per shard of the documents.

A shard is a run of whole documents of about half a megabyte in a task. Words outside the benchmark's vocabulary
can't be part of an occurrence, nor can runs of its words shorter than the shortest window; the index holds the other
runs, parted by a symbol of their own. All windows are searched backward at once through the ranks of a wavelet
matrix over the Burrows-Wheeler transform; occurrences are located by walking to sampled suffix positions, and
their spans are merged. Documents are never shuffled.

The benchmark falls into blocks of about `BLOCK_BYTES` of text. A group of rows builds each block's windows and
writes them to the shared folder; a task holds one block at a time and searches one shard after the other. So a
larger benchmark costs time, not memory, and nothing of it passes through the driver.

Defined cases: a null or empty text has no words; a very long text is a shard of its own; items without words have no
windows; an item without an id marks words but is not counted; items that share an id count once; repeated rows get
equal results; an empty benchmark leaves every document clean; an empty table gives no rows; find() reads doc_id and
text alone, drop_contaminated() and cut_spans() return all columns whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LETTER_WORDS, REMEMBERED, Words, fs_of, lean, pieces, shared_dir, table, table_of, utf8

WINDOW, SHARE, SAMPLED, BLOCK_BYTES, HELD = 13, 20, 16, 2 << 20, 4 << 20
RESULT = "n_words long, n_hit long, n_items long, items array<bigint>, items_sha256 string, contaminated boolean, spans array<struct<start: bigint, end: bigint>>"


class FMIndex:
    """Counts and places of patterns in a text of positive symbols."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        rank, k = text, 1
        while True:  # suffixes by prefix doubling
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:] + 1
            key = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        self.n, bwt = n, text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.bits = max(1, int(text.max()).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):  # wavelet matrix
            one = (bwt >> b & 1).astype(bool)
            self.levels.append((b, np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        marked = order % SAMPLED == 0
        self.marked, self.nth, self.places = marked, np.cumsum(marked) - 1, order[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i of the transform."""
        low = np.zeros_like(i)
        for b, zeros in self.levels:
            one, lz, iz = (c >> b & 1).astype(bool), zeros[low], zeros[i]
            low = np.where(one, zeros[-1] + low - lz, lz)
            i = np.where(one, zeros[-1] + i - iz, iz)
        return i - low

    def back(self, i: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one place before those of rows i."""
        c, low = np.zeros_like(i), np.zeros_like(i)
        for b, zeros in self.levels:
            lz, iz = zeros[low], zeros[i]
            one = zeros[i + 1] == iz
            c |= one.astype(np.int64) << b
            low = np.where(one, zeros[-1] + low - lz, lz)
            i = np.where(one, zeros[-1] + i - iz, iz)
        return self.before[c] + i - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of each pattern; patterns are right-aligned, symbols unknown here are -1."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            at = np.flatnonzero((lengths > step) & (lo < hi))
            c = patterns[at, patterns.shape[1] - 1 - step]
            known = (c >= 0) & (c < len(self.before) - 1)
            lo[at[~known]] = hi[at[~known]] = 0
            at, c = at[known], c[known]
            lo[at], hi[at] = self.before[c] + self.rank(c, lo[at]), self.before[c] + self.rank(c, hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(at):
            done = self.marked[row]
            out[at[done]] = self.places[self.nth[row[done]]] + steps
            at, row, steps = at[~done], self.back(row[~done]), steps + 1
        return out


class Block:
    """Windows of some items: right-aligned symbol rows (2 and up), lengths, and the item ids of each window."""

    def __init__(self, vocabulary: np.ndarray, patterns: np.ndarray, first: np.ndarray, items: np.ndarray):
        self.vocabulary, self.patterns, self.first, self.items = vocabulary, patterns, first, items
        self.lengths = (patterns >= 0).sum(axis=1)

    @classmethod
    def build(cls, texts: pa.Array, ids: pa.Array, window: int) -> Block:
        words: list[np.ndarray] = []
        for _, _, data, off in pieces(*utf8(texts)):
            w = Words(data, off, LETTER_WORDS)
            words += np.split(w.h, w.bounds(len(off) - 1)[1:-1])
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, own in enumerate(words):
            own = (np.searchsorted(vocabulary, own) + 2).astype(np.int32)
            if 0 < len(own) < window:
                own = np.concatenate([np.full(window - len(own), -1, np.int32), own])
            if len(own):
                rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
                owner.append(np.full(len(rows[-1]), k))
        patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        known = np.asarray(ids.is_valid())[np.concatenate(owner)]
        pairs = np.unique(np.stack([which.ravel()[known], np.asarray(ids.cast(pa.int64()).fill_null(0))[np.concatenate(owner)[known]]]), axis=1)
        return cls(vocabulary, patterns, np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1])

    def items_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows: the place in which, and the id, of each of their items."""
        n = self.first[which + 1] - self.first[which]
        place = np.repeat(np.arange(len(which)), n)
        return place, self.items[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.first[which][place]]

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, patterns=self.patterns, first=self.first, items=self.items)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Block:
        with np.load(io.BytesIO(raw)) as x:
            return cls(x["vocabulary"], x["patterns"], x["first"], x["items"])

    def occurrences(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence in a shard of words h of documents row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(h):
            return none
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[k] == h
        if not known.any():
            return none
        start = known.copy()
        start[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        run = np.cumsum(start) - 1
        size = np.bincount(run[known])
        use = np.flatnonzero(known & (size[np.maximum(run, 0)] >= self.lengths.min()))
        if not len(use):
            return none
        cut = np.concatenate([[False], run[use][1:] != run[use][:-1]])
        place = np.arange(len(use)) + np.cumsum(cut)
        text, origin = np.ones(int(place[-1]) + 1, np.int64), np.zeros(int(place[-1]) + 1, np.int64)
        text[place], origin[place] = k[use] + 2, use
        index = FMIndex(text)
        lo, hi = index.search(self.patterns, self.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        return origin[index.locate(rows)], which


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[str, list[int]]:
    """The folder of the blocks' files, and their numbers."""
    folder = shared_dir(benchmark.sparkSession, "benchmark")
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-size // block_bytes)))))

    def build(frame: pa.Table) -> pa.Table:
        k, frame = frame["block"][0].as_py(), frame.combine_chunks()
        fs, base = fs_of(folder)
        fs.create_dir(base, recursive=True)
        passing = f"{base}/.block-{k}.{uuid.uuid4().hex}"
        with fs.open_output_stream(passing) as out:
            out.write(Block.build(frame["text"].combine_chunks(), frame["item_id"].combine_chunks(), window).save())
        if fs.get_file_info(f"{base}/block-{k}.npz").type.name == "File":
            fs.delete_file(passing)  # an attempt before this one wrote the same
        else:
            fs.move(passing, f"{base}/block-{k}.npz")
        return pa.table({"block": pa.array([k], pa.int64())})

    built = table_of(dealt.groupBy("block").applyInArrow(build, "block long"), "blocks")
    return folder, sorted(r.block for r in built.collect())


def block(folder: str, k: int) -> Block:
    own = REMEMBERED.setdefault("decontamination", {})
    if (folder, k) not in own:
        own.clear()  # one block at a time
        fs, base = fs_of(folder)
        with fs.open_input_file(f"{base}/block-{k}.npz") as file:
            own[folder, k] = Block.load(file.read())
    return own[folder, k]


def _merged(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of n places that the spans cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs, the last its text, then those of `RESULT`, by place: names may repeat those of docs.

    spans are the merged removal spans, as [start, end) bytes of the UTF-8 text.
    """
    folder, blocks = blocks_of(benchmark, window, block_bytes)
    at = len(docs.columns) - 1
    result = StructType.fromDDL(RESULT)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def searched(shards: list) -> Iterator[tuple]:
        """Words, bounds, hit words and found items of each shard, by one block after the other."""
        told = [(words, off, np.zeros(len(words.row), bool), {}) for words, off in shards]
        for k in blocks:
            own = block(folder, k)
            for words, _, hit, found in told:
                start, which = own.occurrences(words.h, words.row)
                if len(start):
                    hit |= _merged(start, start + own.lengths[which], len(hit))
                    place, items = own.items_of(which)
                    for r, item in set(zip(words.row[start[place]].tolist(), items.tolist())):
                        found.setdefault(r, set()).add(item)
        yield from told

    def rows_of(words: Words, off: np.ndarray, hit: np.ndarray, found: dict) -> Iterator[tuple]:
        bound = words.bounds(len(off) - 1).tolist()
        for r in range(len(off) - 1):
            a, b = bound[r], bound[r + 1]
            spans, n_hit, items = [], int(hit[a:b].sum()), sorted(found.get(r, ()))
            if n_hit:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))).reshape(-1, 2) + [a, a]
                spans = [{"start": int(words.start[x] - off[r]), "end": int(words.end[y - 1] - off[r])} for x, y in edge.tolist()]
            yield b - a, n_hit, len(items), items, hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n_hit > 0 and share * n_hit >= b - a, spans

    def task(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            shards, size = [], 0
            for first, end, data, off in [*pieces(*utf8(batch.column(at))), (0, 0, b"", None)]:
                if off is not None:
                    shards.append((Words(data, off, LETTER_WORDS), off))
                    size += len(data)
                if shards and (size > (HELD if len(blocks) > 1 else 0) or off is None):
                    for shard in searched(shards):
                        for row in rows_of(*shard):
                            for k, v in enumerate(row):
                                out[k].append(v)
                    shards, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(out, kinds))], [*(f"c{i}" for i in range(at + 1)), *result.names])

    named = docs.toDF(*(f"c{i}" for i in range(at + 1)))
    return named.mapInArrow(lean(task, "decontamination"), StructType([*named.schema.fields, *result.fields]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the columns of `RESULT`."""
    return marked(docs.select("doc_id", F.col("text").cast("string")), benchmark, window, share, block_bytes).withColumnRenamed("c0", "doc_id").drop("c1")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents, in the columns of docs, that are not contaminated; they stay as they are."""
    own = marked(docs.select(*docs.columns, F.col("text").cast("string")), benchmark, window, share)
    return own.filter(~F.col("contaminated")).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs with the removal spans taken out of their texts, which become strings."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans):
            raw, at, left = (t or "").encode(), 0, []
            for s in own:
                left.append(raw[at : s["start"]])
                at = s["end"]
            out.append(None if t is None else b"".join([*left, raw[at:]]).decode())
        return pd.Series(out)

    n, at = len(docs.columns), docs.columns.index("text")
    own = marked(docs.select(*docs.columns, F.col("text").cast("string")), benchmark, window, share)
    return own.withColumn(f"c{at}", cut(f"c{n}", "spans")).select(*(f"c{i}" for i in range(n))).toDF(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")
