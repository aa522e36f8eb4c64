"""Operator 13: grouping of spelling variants by Bloom-guided neighbourhoods.

A vocabulary's words are hashed into blocked Bloom filters, one or more for each length (64-bit blocks, three bytes a
word). Each word's edits are generated as hashes alone, by arithmetic on the word's own: deletions, and replacements by
larger letters, which together find each pair of neighbours from one of its sides. An edit is probed against the filter of
its length; only positives are shuffled, to an exact join with the vocabulary that takes false positives out: first by the
64-bit hash, then by the words themselves.

Filters are broadcast `FILTER_BYTES` at a time at most: a larger vocabulary is probed in rounds, each with the next
filters and only the words whose edits have their lengths. Filters are built in groups of `SHARD_WORDS` words, so no
length needs one task. The driver holds one round's filters, and of the vocabulary only its lengths and letters.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the hash that damages words; a run of
any length is taken whole; words without neighbours are returned with none; ties of n among neighbours fall to the
smallest word in code-point order; repeated rows count each; an empty table gives no rows; columns besides doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, table, table_of

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 7, 2, 10, 31
FILTER_BYTES, SHARD_WORDS, WORD_BYTES = 32 << 20, 1 << 20, 3
PROBES = 1 << 20  # edits that are probed at once
TASK_WORDS = 20_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(docs: DataFrame, damaged: int = DAMAGED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often each word occurs, of those long and frequent enough.

    Of an occurrence whose hash with its document's id is a multiple of `damaged` one code point goes.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    runs = docs.select(ids, F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUNS), 0)).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.filter(F.char_length("run") >= least_length).select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _codes(letters: np.ndarray) -> np.ndarray:
    """64-bit numbers of code points."""
    return mix(letters.astype(np.uint64) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]))


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and code points (a row a word) of the words of each length, in pieces."""
    texts = words.to_pylist()
    sizes = np.array([len(w) for w in texts], np.int64)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        for lo in range(0, len(rows), step := max(1, PROBES // (8 * int(length) + 8))):
            own = rows[lo : lo + step]
            yield int(length), own, np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), int(length))


def hash_of(letters: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of each word's codes times its place's power, see edits_of()."""
    return (_codes(letters) * _powers(letters.shape[1])[: letters.shape[1]]).sum(axis=1)


def edits_of(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, Callable]]:
    """Change of length and hashes of the words' edits: deletions, then replacements by letters of the alphabet.

    With them a function that takes numbers of edits and gives those that count with their words' rows: of replacements
    those by larger letters, since the others are found from their other side. A deletion of any of some equal letters in
    a row is the same word, and comes once.
    """
    m, length = letters.shape
    codes, powers = _codes(letters), _powers(length)
    terms = codes * powers[:length]
    before = np.cumsum(terms, axis=1) - terms
    whole = before[:, -1] + terms[:, -1]
    once = np.ones((m, length), bool)
    once[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, at = np.nonzero(once)
    yield -1, before[row, at] + (whole[row] - before[row, at] - terms[row, at]) * _BACK, lambda k: (k, row[k])
    own = _codes(alphabet)

    def larger(lo: int, step: int) -> Callable:
        def pick(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows, places, which = np.unravel_index(k, (m, step, len(alphabet)))
            kept = alphabet[which] > letters[rows, places + lo]
            return k[kept], rows[kept]

        return pick

    for lo in range(0, length, step := max(1, PROBES // (m * len(alphabet) + 1))):
        hi = min(lo + step, length)
        changed = (own[None, None, :] - codes[:, lo:hi, None]) * powers[None, lo:hi, None]
        changed += whole[:, None, None]
        yield 0, changed.ravel(), larger(lo, hi - lo)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _block_and_bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's block in a filter, and the four bits it sets there."""
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    bits = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((x >> np.uint64(shift)) & np.uint64(63))
    return ((x >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), bits


def filter_of(h: np.ndarray) -> np.ndarray:
    """The blocked Bloom filter of hashes."""
    out = np.zeros(max(1, -(-len(h) * WORD_BYTES // 8)), np.uint64)
    block, bits = _block_and_bits(h, len(out))
    np.bitwise_or.at(out, block, bits)
    return out


def within(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: all that it was made of, and few others."""
    block, bits = _block_and_bits(h, len(own))
    return (own[block] & bits) == bits


def _hashed(batches):
    for batch in batches:
        h = np.zeros(batch.num_rows, np.uint64)
        for _, rows, letters in _by_length(batch.column(0)):
            h[rows] = hash_of(letters)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], ["word", "n", "length", "h"])


def _filters(vocabulary: DataFrame, shards: dict[int, int]) -> DataFrame:
    """length, shard, bits: the filter of each shard, built in a group of its own."""

    def numbered(batches):
        for batch in batches:
            length, h = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            shard = np.zeros(len(h), np.int64)
            for n in np.unique(length):
                shard[length == n] = _shard(h[length == n], shards[int(n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard), batch.column(1)], ["length", "shard", "h"])

    def build(frame: pa.Table) -> pa.Table:
        bits = filter_of(np.asarray(frame["h"]).view(np.uint64)).tobytes()
        return pa.table({"length": frame["length"][:1], "shard": frame["shard"][:1], "bits": pa.array([bits], pa.binary())})

    return vocabulary.select("length", "h").mapInArrow(numbered, "length int, shard long, h long").groupBy("length", "shard").applyInArrow(build, "length int, shard long, bits binary")


def _rounds(sizes: list[tuple[int, int]], shards: dict[int, int], most: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of (length, shard) whose filters take `most` bytes together at most, one shard at least."""
    held, total = [], 0
    for length, n in sizes:
        each = n * WORD_BYTES / shards[length]
        for shard in range(shards[length]):
            if held and total + each > most:
                yield held
                held, total = [], 0
            held.append((length, shard))
            total += each
    if held:
        yield held


def neighbours(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, other, other_n: every ordered pair of words of vocabulary (word, n) that one edit parts."""
    spark = vocabulary.sparkSession
    own = table_of(vocabulary.select("word", F.col("n").cast("long").alias("n"), F.char_length("word").alias("length")).mapInArrow(lean(_hashed), "word string, n long, length int, h long"), "vocabulary")
    sizes = [(r["length"], r["n"]) for r in own.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()]  # a row a length
    letters = own.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()  # of the runs' letters alone, 116 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)
    shards = {length: -(-n // shard_words) for length, n in sizes}
    filters = table_of(_filters(own, shards), "filters")
    total = sum(n for _, n in sizes)
    found = None
    for mine in _rounds(sizes, shards, filter_bytes):
        told = spark.createDataFrame(mine, "length int, shard long")
        sent = spark.sparkContext.broadcast({(r["length"], r["shard"]): r["bits"] for r in filters.join(F.broadcast(told), ["length", "shard"]).collect()})  # filter_bytes at most
        lengths = sorted({n for n, _ in mine})

        def probe(batches, sent=sent):
            held = {k: np.frombuffer(bits, np.uint64) for k, bits in sent.value.items()}
            for batch in batches:
                for length, rows, points in _by_length(batch.column(0)):
                    if not any((length + d, s) in held for d in (0, -1) for s in range(shards.get(length + d, 0))):
                        continue
                    h = hash_of(points)
                    for change, edit, pick in edits_of(points, alphabet):
                        there = length + change
                        part = _shard(edit, shards[there]) if shards.get(there, 1) > 1 else None
                        for s in range(shards.get(there, 0)):
                            if (there, s) not in held:
                                continue
                            if part is None:
                                k = np.flatnonzero(within(held[there, s], edit))
                            else:
                                k = np.flatnonzero(part == s)
                                k = k[within(held[there, s], edit[k])]
                            k, row = pick(k)
                            if len(k):
                                yield pa.RecordBatch.from_arrays([pa.array(edit[k].view(np.int64)), pa.array(np.full(len(k), there, np.int32)), pa.array(h[row].view(np.int64)), pa.array(np.full(len(k), length, np.int32))], ["h", "length", "from_h", "from_length"])

        near = own.filter(F.col("length").isin(lengths + [n + 1 for n in lengths])).select("word").repartition(max(4, total // TASK_WORDS))
        positive = near.mapInArrow(lean(probe), "h long, length int, from_h long, from_length int")
        found = positive if found is None else found.unionByName(positive)
    if found is None:
        return own.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).filter("false")
    other = own.select("h", "length", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = found.join(other, ["h", "length"]).drop("h", "length").withColumnsRenamed({"from_h": "h", "from_length": "length"}).join(own, ["h", "length"])
    pairs = table_of(pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct(), "neighbours")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def grouped(vocabulary: DataFrame, times: int = TIMES, filter_bytes: int = FILTER_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of vocabulary (word, n).

    form: the most frequent neighbour, if it is `times` as frequent; root: where forms lead. Each form is more frequent
    than its word, so they never lead round, and as many doublings as its logarithm's logarithm reach every root.
    """
    words = table_of(vocabulary.select("word", F.col("n").cast("long").alias("n")), "words")
    best = neighbours(words, filter_bytes, shard_words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    told = table_of(best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    step = told.filter("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.ceil(math.log(most, times)) if times > 1 else 64)  # steps from any word to its root at most
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = table_of(step.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    rows = words.join(told, "word", "left").join(step, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(words_of(table(spark, sf_dir, "documents")))
