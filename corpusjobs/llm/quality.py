"""Operator 10: quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words fall in `WORD_BUCKETS` hash buckets; the shape of a word (classes of its characters, runs collapsed, and
whether it repeats the word before) falls in `SHAPE_BUCKETS`. Each bucket has a fixed sparse ternary index
vector. Its word vector is the sum of the index vectors of the words within `REACH` places, over all documents;
the table of sums has a fixed size whatever the input. A document is pooled to mean and deviation of its word
and shape vectors. A two-layer network is fitted in numpy on at most `SAMPLE` labelled documents, and a
temperature is fitted on a fifth of them that the weights have not seen.

Defined cases: null, empty and white-space texts are pooled to zeros and scored as such; a very long text is pooled
whole; a score of exactly a half is predicted 1; repeated rows get equal scores, and the fit takes one row of an id; a
null doc_id is never labelled and is in fold crc32('') mod 3; without labels of both kinds every score is 0.5; an empty
table gives no rows; only doc_id and text are read, and with keep all columns come back whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, fold_of, labelled_sample, lean, mix, pieces, table, utf8, with_text

WORD_BUCKETS, SHAPE_BUCKETS, SIZE, REACH, SAMPLE = 1 << 14, 1 << 10, 32, 2, 12_000
ITEMS = WORD_BUCKETS + SHAPE_BUCKETS
FEATURES = 4 * SIZE + 2
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3


def index_vectors() -> np.ndarray:
    """Ternary vectors with four entries each, the same wherever they are made."""
    out = np.zeros((ITEMS, SIZE), np.float32)
    for k in range(4):
        h = mix(np.arange(ITEMS, dtype=np.uint64) * np.uint64(8) + np.uint64(k))
        out[np.arange(ITEMS), (h % np.uint64(SIZE)).astype(int)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def items_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape bucket and row of each word of a piece."""
    words = Words(data, off, SPACE_WORDS)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~SPACE_WORDS[data[1:]]
    inner = off[1:-1]
    keep[inner[inner < len(kind)]] = True
    shorter = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=shorter[1:])
    shapes = Words(kind[keep], shorter[off], SPACE_WORDS)
    again = np.zeros(len(words.h), bool)
    again[1:] = (words.h[1:] == words.h[:-1]) & (words.row[1:] == words.row[:-1])
    shape = mix(shapes.h + again.astype(np.uint64)) % np.uint64(SHAPE_BUCKETS)
    return (words.h % np.uint64(WORD_BUCKETS)).astype(np.int64), shape.astype(np.int64) + WORD_BUCKETS, words.row


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all documents: ITEMS x SIZE, each of length 1 after the mean is taken off."""

    def gather(batches):
        index, sums = index_vectors(), np.zeros((ITEMS, SIZE), np.float64)
        for batch in batches:
            for _, _, data, off in pieces(*utf8(batch.column(0))):
                word, shape, row = items_of(data, off)
                if not len(word):
                    continue
                own = index[word] + index[shape]
                near = np.zeros_like(own)
                for d in range(1, REACH + 1):
                    same = (row[d:] == row[:-d])[:, None]
                    near[d:] += own[:-d] * same
                    near[:-d] += own[d:] * same
                for k in range(SIZE):
                    sums[:, k] += np.bincount(word, near[:, k], ITEMS) + np.bincount(shape, near[:, k], ITEMS)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(sums[used, k]) for k in range(SIZE))], ["item", *(f"v{k}" for k in range(SIZE))])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(gather), "item int, " + ", ".join(f"v{k} double" for k in range(SIZE)))
    total = parts.groupBy("item").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE))).toPandas()  # ITEMS rows at most
    out = np.zeros((ITEMS, SIZE))
    out[total["item"].to_numpy(int)] = total.drop(columns="item").to_numpy(float)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.where(length == 0, 1, length)
    if len(total):
        out[length[:, 0] > 0] -= out[length[:, 0] > 0].mean(axis=0)
    return out.astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of the documents of a piece."""
    rows = len(off) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    word, shape, row = items_of(data, off)
    if not len(word):
        return out
    has, first = np.unique(row, return_index=True)
    n = np.diff(np.append(first, len(row))).astype(np.float32)[:, None]
    for k, ids in enumerate((word, shape)):
        v = vectors[ids]
        mean = np.add.reduceat(v, first, axis=0) / n
        square = np.add.reduceat(v * v, first, axis=0) / n
        out[has, 2 * k * SIZE : (2 * k + 1) * SIZE] = mean
        out[has, (2 * k + 1) * SIZE : (2 * k + 2) * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[has, -2], out[has, -1] = np.log1p(n[:, 0]), np.linalg.norm(out[has, :SIZE], axis=1)
    return out


class Network:
    """Two layers: tanh units, then one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray, units: int = 32, rounds: int = 60, rate: float = 5e-3, decay: float = 1e-4):
        rng = np.random.default_rng(7)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)).astype(np.float32), np.zeros(units, np.float32), rng.normal(0, 1 / np.sqrt(units), units).astype(np.float32), np.zeros(1, np.float32)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                a, b = x[at], y[at].astype(np.float32)
                h = np.tanh(a @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - b) / len(at)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.w[k] * (k % 2 == 0))
        self.temperature = 1.0
        logits = self.logits(check_x)
        if len(check_y):
            loss = lambda t: np.logaddexp(0, np.where(check_y == 1, -logits, logits) / t).mean()
            self.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 61)), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network | None:
    """A network from at most `sample` labelled documents; None unless both labels occur."""

    def features(batches):
        for batch in batches:
            x = [pooled(data, off, vectors) for _, _, data, off in pieces(*utf8(batch.column(0)))]
            if x:
                x = np.concatenate(x)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "h", "x"])

    got = labelled_sample(docs, labels, "quality", sample).select("text", "y", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(lean(features), "y int, h long, x binary").toPandas().sort_values(["h", "x"])
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(y), FEATURES)
    check = np.arange(len(y)) % 5 == 0
    return Network(x[~check], y[~check], x[check], y[check])


def classify(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """docs with score and predicted (1: good); with keep only the rows predicted good, in the columns of docs."""
    vectors = word_vectors(docs)
    model = fit(docs, labels, vectors)
    names = docs.columns
    kept, text = with_text(docs) if keep else (docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string")), "text")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            parts = [model.score(pooled(data, off, vectors)) if model else np.full(hi - lo, 0.5) for lo, hi, data, off in pieces(*utf8(batch.column(at)))]
            score = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            if keep:
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(score >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if keep:
        return kept.mapInArrow(lean(run), docs.schema)
    return kept.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
