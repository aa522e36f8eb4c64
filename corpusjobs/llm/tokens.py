"""Operator 11: alignment of the tokens of two tokenizers by their byte ranges.

A byte-level vocabulary (A) and one of pieces with byte fallback (B) cut the same text, a space and then the document.
Per batch, each token's start finds the other side's covering token by pandas merge_asof, keyed by the document's first
byte in the batch; both directions together are all overlaps. Overlaps whose tokens end together are links; their ends
cut the tokens into groups.

A pair of ids has one count over the whole corpus. Documents are gathered in runs of `RUN_BYTES` of text: a row of the
written table holds a run's documents, its different pairs with their counts, and the pair of each link. A row for each
run and pair goes through an exchange to the pair's count and back to its run (very common pairs meet theirs by
broadcast, see join_hot()); there the counts meet the links. A B id has as many pairs as A has ids at most.

Defined cases: a null or empty text, and one whose tokens' bytes aren't the text's, has no tokens, zeros and an empty
digest; very long texts are taken whole, in a run of their own; a null doc_id is kept; repeated rows count each; ties of
counts all are best; an empty table gives no rows; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, give_back, join_hot, lean, pieces, table, table_of, utf8

RUN_BYTES = 4 << 20
#: Characters of a text from which on pieces are asked for segment by segment.
LONG = 1 << 16
#: How byte-level vocabularies cut texts before their merges, and their bytes that stand for themselves.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters below this have had their classes for long, whatever the version of Unicode.
PLAIN_END = "԰"
_NEW = re.compile(f"[^\x00-{chr(ord(PLAIN_END) - 1)}]")
_SEGMENT = re.compile("(?<=[^ ]) +[^ ]")

DOCUMENT = ["ids", "n_a", "n_b", "n_groups", "n_links", "sha"]


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: shown ones stand for themselves, others follow from 256 on."""
    others = [b for b in range(256) if b not in SHOWN_BYTES]
    return {chr(b): b for b in SHOWN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}


class Ids:
    """The ids of texts by a vocabulary; tokens: each id's bytes."""

    def __init__(self, tokens: list[bytes], encode: Callable[[str], Iterable[int]]):
        self.tokens, self.encode = tokens, encode
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, which begins with a space or is empty; none if their bytes aren't the text's."""
        out = []
        for text in texts:
            ids = array("I", self.encode(text) if text else ())
            same = b"".join(map(self.tokens.__getitem__, ids)) == text.encode()
            out.append(np.frombuffer(ids if same else b"", np.uint32))
        return out


def by_ranks(model: dict, entries: dict[bytes, int], alone: Callable[[str], list]) -> bool:
    """Whether merging the neighbours whose joined bytes have the least id gives what the listed merges give.

    It does if the merges' ids ascend and each entry, alone, is encoded as itself: two neighbours stand beside each other
    as they do where their joined text is alone, and of its two halves only the listed ones ever do.
    """
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    ascending = all(x < y for x, y in zip(made, made[1:]))
    ids = set(entries.values())
    whole = all([t.id for t in alone(e)] == [k] for e, k in model["vocab"].items() if k in ids)
    return plain and ascending and whole and sum(len(e) == 1 for e in entries) == 256


def byte_ids(path: str) -> Ids:
    """Of a byte-level vocabulary of the tokenizers library; special tokens' strings are plain text.

    Where by_ranks() holds, texts of characters whose classes are settled are merged by tiktoken, others by the library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    told, decode = json.loads(own.to_str()), byte_of()
    special = {t["id"] for t in told["added_tokens"]}
    vocabulary = own.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        tokens[k] = entry.encode() if k in special else bytes(decode[c] for c in entry)
    entries = {tokens[k]: k for k in vocabulary.values() if k not in special}
    cuts = told["pre_tokenizer"] or {}
    shape = told["normalizer"], cuts.get("type"), cuts.get("use_regex"), cuts.get("add_prefix_space"), told["model"]["type"]
    whole = lambda text: own.encode(text, add_special_tokens=False).ids
    if shape != (None, "ByteLevel", True, False, "BPE") or not by_ranks(told["model"], entries, own.model.tokenize):
        return Ids(tokens, whole)
    ranked = tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=entries, special_tokens={})
    return Ids(tokens, lambda text: whole(text) if _NEW.search(text) else ranked.encode_ordinary(text))


def piece_ids(path: str) -> Ids:
    """Of a sentencepiece model, which puts the first space there itself; U+2581 in a piece is a space, <0xHH> a byte.

    Long texts are asked for in runs of segments, each of spaces and what follows them, where no piece goes on over a
    space and so no merge does.
    """
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [own.id_to_piece(k) for k in range(own.piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(entries)]
    apart = not any("▁" in p.lstrip("▁") for p in entries)
    encode = lambda text: own.encode(text[1:], num_threads=1)

    def by_segments(text: str) -> array:
        ids, lo = array("I"), 0
        while cut := _SEGMENT.search(text, lo + LONG):
            ids.extend(encode(text[lo : cut.start()]))
            lo = cut.start()
        ids.extend(encode(text[lo:]))
        return ids

    return Ids(tokens, lambda text: by_segments(text) if apart and len(text) > LONG and "▁" not in text and not _NEW.search(text) else encode(text))


def ids_of(a: str, b: str) -> tuple[Ids, Ids]:
    own = REMEMBERED.setdefault("tokens", {})
    if (a, b) not in own:
        own.clear()
        own[a, b] = byte_ids(a), piece_ids(b)
        give_back("tokens")  # what reading the files took
    return own[a, b]


def overlaps(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of each pair that overlaps, for ascending starts whose tokens leave no gaps.

    Starts count from a batch's first byte, and both sides' first tokens of a document start at its first byte. So the
    key holds the document too: no token finds one of another document.
    """
    a = pd.DataFrame({"start": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "b": np.arange(len(start_b))})
    forth, back = pd.merge_asof(a, b, on="start"), pd.merge_asof(b, a, on="start")
    back = back[start_a[back["a"]] < back["start"]]  # pairs that start together are there already
    return np.concatenate([forth["a"], back["a"]]), np.concatenate([forth["b"], back["b"]])


class Aligned:
    """Tokens of a batch of texts: doc_a, a, end_a: document, id and end of each A token; so for B; link_a, link_b: linked tokens."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (a, b))
        rows = np.arange(len(a))
        self.doc_a, self.doc_b = np.repeat(rows, self.n_a), np.repeat(rows, self.n_b)
        self.end_a, self.end_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        x, y = overlaps(self.end_a - sizes_a[self.a], self.end_b - sizes_b[self.b])
        linked = self.end_a[x] == self.end_b[y]
        order = np.argsort(x[linked], kind="stable")
        self.link_a, self.link_b = x[linked][order], y[linked][order]

    def group_texts(self, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' groups as text, and where each document's ends; shown: see shown_ids()."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.link_a], last_b[self.link_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # both sides have each group
        groups = len(self.link_a)
        before_a, before_b = np.cumsum(np.bincount(group_a, minlength=groups)), np.cumsum(np.bincount(group_b, minlength=groups))
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.append(0, before_b)[group_a]] = self.a << 2 | np.where(last_a, 1, 0)
        out[np.arange(len(self.b)) + before_a[group_b] if groups else np.zeros(0, np.int64)] = self.b << 2 | np.where(last_b, 2, 0)
        flat = shown[out].view(np.uint8).reshape(-1, shown.itemsize)
        size = (flat != 0).sum(axis=1)
        per_doc = np.cumsum(np.append(0, size))[np.cumsum(self.n_a + self.n_b)]
        flat = flat.ravel()
        return flat[flat != 0], per_doc


def shown_ids(n: int) -> np.ndarray:
    """At 4 * id + k: the decimal id followed by a comma, a bar or a semicolon."""
    return np.array([f"{k // 4}{',|;,'[k % 4]}".encode() for k in range(4 * n)])


class Run:
    """Documents that are written in one row, their links counted by pair."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.docs = self.bytes = 0
        self.codes: list[np.ndarray] = []

    def take(self, ids: pa.Array, own: Aligned, shown: np.ndarray, size: int) -> None:
        text, ends = own.group_texts(shown)
        raw, starts = text.tobytes(), np.append(0, ends[:-1])
        digests = [hashlib.sha256(raw[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(starts.tolist(), ends.tolist())]
        links = np.bincount(own.doc_a[own.link_a], minlength=len(own.n_a))
        self.rows.append((ids, own.n_a, own.n_b, links, links, digests))
        self.codes.append(own.a[own.link_a] << 32 | own.b[own.link_b])
        self.docs, self.bytes = self.docs + len(own.n_a), self.bytes + size

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        local, codes = pd.factorize(np.concatenate(self.codes))
        order = np.argsort(codes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n = np.bincount(local, minlength=len(codes))[order]
        of = lambda values, k: pa.array([values], pa.list_(k))
        ids = pa.chunked_array([r[0] for r in self.rows]).combine_chunks()
        parts = [np.concatenate([r[k] for r in self.rows]) for k in range(1, 5)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(of(p, pa.int64()) for p in parts), of([d for r in self.rows for d in r[5]], pa.string()), of(codes[order], pa.int64()), of(n, pa.int64()), of(place[local].astype(np.int32), pa.int32())],
            ["run", *DOCUMENT, "codes", "counts", "links"],
        )


def align(docs: DataFrame, a: str, b: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a, b: the vocabularies' files."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gathered(batches) -> Iterator[pa.RecordBatch]:
        by_a, by_b = ids_of(a, b)
        shown = shown_ids(max(len(by_a.tokens), len(by_b.tokens)))
        task, number, run, arrow = TaskContext.get().partitionId() << 24, 0, Run(), None
        none = np.zeros(0, np.uint32)
        for batch in batches:
            arrow = batch.schema.field(0).type
            for lo, hi, data, off in pieces(*utf8(batch.column(1))):
                texts = [" " + data[s:e].tobytes().decode("utf-8", "replace") if e > s else "" for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                pairs = [p if len(p[0]) and len(p[1]) else (none, none) for p in zip(by_a.of(texts), by_b.of(texts))]
                run.take(batch.column(0)[lo:hi], Aligned([p[0] for p in pairs], [p[1] for p in pairs], by_a.sizes, by_b.sizes), shown, len(data))
                if run.bytes >= run_bytes:
                    yield run.row(task + number, arrow)
                    run, number = Run(), number + 1
        if run.docs:
            yield run.row(task + number, arrow)

    lists = f"ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, codes array<long>, counts array<long>, links array<int>"
    runs = table_of(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(gathered, "tokens"), f"run long, {lists}"), "token-runs", large=True)
    pairs = runs.select("run", F.inline(F.arrays_zip("codes", "counts"))).withColumnsRenamed({"codes": "code", "counts": "n"})
    counts = pairs.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("runs"))
    most = F.max("n").over(Window.partitionBy(F.col("code").bitwiseAND(0xFFFFFFFF)))
    counts = table_of(counts.select("code", "n", "runs", (F.col("n") == most).alias("best")), "token-pairs")
    told = join_hot(pairs.select("run", "code"), counts, "code", "runs").select(F.col("run").alias("of_run"), "code", "n", "best")

    def counted(own: pa.Table, told: pa.Table) -> pa.Table:
        give_back("")  # the worker has no use for what it remembers of the vocabularies
        row = own.slice(0, 1)
        flat = lambda name: row[name].combine_chunks().flatten()
        code, n, best = (np.asarray(told[c].combine_chunks().cast(pa.int64())) for c in ("code", "n", "best"))
        order = np.argsort(code)
        if not np.array_equal(code[order], np.asarray(flat("codes"))):
            raise ValueError(f"run {row['run'][0]} hasn't the pairs that its rows tell")
        n, best = n[order], best[order]
        link, docs_in = np.asarray(flat("links")).astype(np.int64), np.repeat(np.arange(len(flat("ids"))), np.asarray(flat("n_links")))
        sums = [np.bincount(docs_in, best[link], len(flat("ids"))).astype(np.int64), np.zeros(len(flat("ids")), np.int64)]
        np.add.at(sums[1], docs_in, n[link])
        return pa.table({"doc_id": flat("ids"), "n_a": flat("n_a"), "n_b": flat("n_b"), "n_groups": flat("n_groups"), "n_links": flat("n_links"), "n_best": sums[0], "count_sum": sums[1], "groups_sha256": flat("sha")})

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return runs.groupBy("run").cogroup(told.groupBy("of_run")).applyInArrow(counted, schema)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
