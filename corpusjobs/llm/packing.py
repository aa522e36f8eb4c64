"""Operator 4: packing of documents into training sequences, by bounded-space online best fit.

Each partition tokenises its documents and keeps `windows` open windows. A document is cut into full
sequences and a rest; the rest goes to the open window it fills best. Where it fits in none, the fullest
window is topped up by a cut of it and emitted, and what remains is placed again, so that no emitted window
has padding. At its end a partition joins its open windows into full ones and hands on one leftover window;
leftovers of `fan_in` partitions at a time are joined again until one is left. Only this last sequence is padded.

Defined cases: a null text is empty; an empty document has the end id alone; a document longer than a
sequence is cut; of windows that fit equally the first opened is taken; a repeated row is packed again under its doc_id;
a null doc_id is kept; an empty table gives no pieces; columns besides doc_id and text are not read, whatever their
names. A sequence's id is the task's number times 2**32 plus
its number there, with the level of joining in the top bits.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, lean, table, table_of

LENGTH, WINDOWS, FAN_IN, END_ID = 2048, 32, 256, 1
#: Words, and parts of words, that a worker remembers with their ids (twice as many at most, of 200 bytes each or less:
#: an executor's memory holds all its workers' beside the heap of the stages before), and the longest of them.
MOST_WORDS, LONGEST = 150_000, 64
#: Control characters that str.split() takes for white space and the tokenizer doesn't.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: The steps of a tokenizer that can be asked word by word.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Characters below this are in normal form C whatever stands beside them, and their classes are the same in all versions of Unicode.
PLAIN_END = "\u0180"
_OF_CLASS = {k: "".join(re.escape(c) for c in map(chr, range(ord(PLAIN_END))) if unicodedata.category(c)[0] == k) for k in "LN"}
#: CUTS for words of these characters, lower-cased; the dot above follows where a dotted capital I is lower-cased.
PARTS = re.compile(CUTS.replace("[\\p{L}]+", f"[{_OF_CLASS['L']}]+").replace("[\\p{N}]", f"[{_OF_CLASS['N']}]").replace("\\p{L}\\p{N}", _OF_CLASS["L"] + _OF_CLASS["N"]))
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordIds(dict):
    """Ids of texts, as the tokenizer's own encode() gives them without special tokens added.

    A tokenizer that drops white space and never joins across it is asked word by word: words and their parts are
    remembered with their ids, those used last, `most` at least and twice as many at most. Any other tokenizer is
    asked for whole texts. So are texts that hold one of its added tokens, or controls that split() alone takes for
    white space.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.most, self.older, self.tokenizer = most, {}, Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_word = (told["normalizer"], told["pre_tokenizer"], told["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None) and told["model"]["type"] == "BPE"
        self.whole = re.compile("|".join(map(re.escape, [*CONTROLS, *(t["content"] for t in told["added_tokens"])])))
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def learn(self, word: str) -> bytes:
        if not (word.isascii() or max(word) < PLAIN_END):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        parts = PARTS.findall(word.lower())
        if parts != [word]:
            return b"".join(map(self.__getitem__, parts))
        shown = word if word.isascii() and word.isprintable() else self.bytes.pre_tokenize_str(word)[0][0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        for t in texts:
            if not self.by_word or self.whole.search(t):
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            if t.isascii() or max(t) < PLAIN_END:
                t = t.lower()  # fewer different words; the result is the same
            yield np.frombuffer(b"".join(map(self.__getitem__, t.split())), np.uint32)


def ids_of(path: str) -> WordIds:
    own = REMEMBERED.setdefault("packing", {})
    if path not in own:
        own[path] = WordIds(path)
    return own[path]


class Packer:
    """Open windows of one partition. Rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset, ids)."""

    def __init__(self, first_id: int, length: int, windows: int):
        self.next_id, self.length, self.most = first_id, length, windows
        self.open: list[tuple[int, int]] = []  # (room, window number), ascending
        self.held: dict[int, list] = {}
        self.number = 0
        self.rows: list[tuple] = []

    def emit(self, parts: list, keep_ids: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in parts:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, None if keep_ids else self.next_id, at, raw if keep_ids else None))
            at += len(ids)
        self.next_id += not keep_ids

    def place(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.length:
                self.emit([(doc_id, start, ids[: self.length], total)])
                start, ids = start + self.length, ids[self.length :]
                continue
            k = bisect_left(self.open, (len(ids), -1))
            if k < len(self.open):  # the window with the least room that is enough
                room, w = self.open.pop(k)
                self.held[w].append((doc_id, start, ids, total))
                if room == len(ids):
                    self.emit(self.held.pop(w))
                else:
                    insort(self.open, (room - len(ids), w))
                return
            if len(self.open) < self.most:
                self.held[self.number] = [(doc_id, start, ids, total)]
                insort(self.open, (self.length - len(ids), self.number))
                self.number += 1
                return
            room, w = self.open.pop(0)  # none fits: the fullest is topped up and goes
            self.emit([*self.held.pop(w), (doc_id, start, ids[:room], total)])
            start, ids = start + room, ids[room:]

    def close(self) -> list:
        """Joins the open windows into full sequences; what is left, less than one."""
        rest = [p for _, w in sorted(self.open) for p in self.held[w]]
        parts: list = []
        at = 0
        for doc_id, start, ids, total in rest:
            while at + len(ids) >= self.length:
                cut = self.length - at
                self.emit([*parts, (doc_id, start, ids[:cut], total)])
                parts, at, start, ids = [], 0, start + cut, ids[cut:]
            if len(ids):
                parts.append((doc_id, start, ids, total))
                at += len(ids)
        self.open, self.held = [], {}
        return parts


def _batches(rows: list[tuple], kind: pa.DataType, extra: int | None = None) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)]
    if extra is not None:
        return pa.RecordBatch.from_arrays([*columns, pa.array([extra] * len(rows), pa.int64())], [*names, "source"])
    return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, fan_in: int = FAN_IN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def first(batches):
        task = TaskContext.get().partitionId()
        packer, words = Packer(task << 32, length, windows), ids_of(tokenizer)
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0)[lo : lo + 512].to_pylist(), [t or "" for t in batch.column(1)[lo : lo + 512].to_pylist()]
                for doc_id, own in zip(ids, words.of(texts)):
                    own = np.append(own, np.uint32(end_id))
                    packer.place(doc_id, 0, own, len(own))
            yield _batches(packer.rows, arrow, task)
            packer.rows = []
        packer.emit(packer.close(), True)
        if arrow is not None:
            yield _batches(packer.rows, arrow, task)

    def join(level: int, top: bool):
        def joined(frame: pa.Table) -> pa.Table:
            group, arrow = frame["g"][0].as_py(), frame.schema.field("doc_id").type
            packer = Packer((level << 56) | (group << 32), length, 1)
            for r in frame.sort_by([("source", "ascending"), ("offset", "ascending")]).to_pylist():
                packer.held[packer.number] = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])]
                packer.open.append((packer.number, packer.number))
                packer.number += 1
            parts = packer.close()
            if parts:
                packer.emit(parts, not top)
            return pa.Table.from_batches([_batches(packer.rows, arrow, group)])

        return joined

    schema = f"doc_id {kind}, {COLUMNS}, source long"
    done = table_of(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(first, "packing"), schema), "packing")
    result = done.filter("sequence_id is not null")
    left, level = done.filter("sequence_id is null"), 1
    groups = max(1, (left.agg(F.max("source")).first()[0] or 0) + 1)
    while True:
        top = groups <= fan_in
        left = left.withColumn("g", F.expr(f"source div {fan_in}")).groupBy("g").applyInArrow(join(level, top), schema)
        if top:
            result = result.unionByName(left)
            break
        left = table_of(left, "packing-left")
        result = result.unionByName(left.filter("sequence_id is not null"))
        left, level, groups = left.filter("sequence_id is null"), level + 1, -(-groups // fan_in)
    return result.drop("ids", "source")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents; ids by the public word-piece vocabulary of 49k entries."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
