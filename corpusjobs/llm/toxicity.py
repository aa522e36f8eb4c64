"""Operator 1: toxicity grades by cumulative-link ordinal regression on sparse text features.

Features: the different words of a document and their beginnings of 3 to 8 bytes, hashed to 64 bits. Of those
in at most `SAMPLE` labelled documents, the `FEATURES` that set toxic ones apart most surely (by the z-score of
their toxic document frequency, `LEAST_Z` at least) carry weights. The labels say only toxic or not; grades 1 to
`GRADES` of toxic documents are the quantiles of their number of different telling features. One weight
vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), theta ascending. Severity is the
expected grade; a document is toxic where P(grade > 0) is at least a half.

Defined cases: null and empty texts have no features and get the grade that this implies; a very long text is read
whole; of equally telling features those with the lowest hashes count; repeated rows get equal grades, and the fit
takes one row of an id; a null doc_id is never labelled; without labels of both kinds severity and probability are 0;
an empty table gives no rows; only doc_id and text are read, and with keep all columns come back whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER_WORDS, Words, labelled_sample, lean, mix, pieces, table, utf8, with_text

SAMPLE, FEATURES, GRADES, LEAST_Z = 12_000, 512, 3, 5.0
BEGINNINGS = range(3, 9)


def features_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word and beginning of a piece, repeats included."""
    words = Words(data, off, LETTER_WORDS)
    h, row = [words.h], [words.row]
    for k in BEGINNINGS:
        long = words.end - words.start > k
        h.append(mix(words.span(words.start[long], words.start[long] + k) + np.uint64(k)))
        row.append(words.row[long])
    return np.concatenate(h), np.concatenate(row)


def telling(sample: DataFrame, features: int, least_z: float) -> np.ndarray:
    """Hashes of the features that set toxic documents apart, ascending."""

    def count(batches):
        for batch in batches:
            y = np.asarray(batch.column(1))
            for lo, hi, data, off in pieces(*utf8(batch.column(0))):
                h, row = features_of(data, off)
                pair = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                own, back = np.unique(pair[0], return_inverse=True)
                n = np.bincount(back, minlength=len(own))
                toxic = np.bincount(back, y[lo:hi][pair[1].astype(int)], len(own)).astype(np.int64) if len(own) else n
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(toxic)], ["h", "n", "toxic"])

    docs, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < docs:
        return np.zeros(0, np.uint64)
    p = toxic / docs
    counts = sample.select("text", "y").mapInArrow(lean(count), "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    best = counts.withColumn("z", z).filter((F.col("z") >= least_z) & (F.col("toxic") >= 3)).orderBy(F.desc("z"), "h").limit(features)
    return np.sort(np.array([r.h for r in best.select("h").collect()], np.int64).view(np.uint64))


def presence(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of each telling feature that occurs, repeats included."""
    h, row = features_of(data, off)
    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[k] == h
    return row[hit], k[hit]


class CumulativeLink:
    """Shared weights over ordered thresholds, fitted by gradient steps with weight decay."""

    def __init__(self, x: np.ndarray, grade: np.ndarray, top: int, rounds: int = 1000, rate: float = 0.05, decay: float = 2e-6):
        self.w, raw = np.zeros(x.shape[1], np.float32), np.concatenate([[1.0], np.zeros(top - 1)])
        above = (grade[:, None] > np.arange(top)).astype(np.float32)
        m = v = np.zeros(len(self.w) + top)
        for step in range(1, rounds + 1):
            self.theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            d = (self.above(x) - above) / len(x)
            g_theta = -d.sum(axis=0)
            g_raw = np.cumsum(g_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
            g = np.concatenate([x.T @ d.sum(axis=1).astype(np.float32) + decay * self.w, g_raw])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.w = (self.w - move[: len(self.w)]).astype(np.float32)
            raw = raw - move[len(self.w) :]
        self.theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    def from_sum(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.theta, -60, 60)))

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k from 0."""
        return self.from_sum(x @ self.w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES, least_z: float = LEAST_Z):
    """The vocabulary and the model; None unless there are telling features."""
    chosen = labelled_sample(docs, labels, "toxic", sample)
    vocabulary = telling(chosen, features, least_z)
    if not len(vocabulary):
        return None

    def rows(batches):
        for batch in batches:
            out = []
            for lo, hi, data, off in pieces(*utf8(batch.column(0))):
                row, k = presence(data, off, vocabulary)
                x = np.zeros((hi - lo, len(vocabulary)), np.uint8)
                x[row, k] = 1
                out += [np.packbits(a).tobytes() for a in x]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["y", "x"])

    got = chosen.select("text", "y").mapInArrow(lean(rows), "y int, x binary").toPandas().sort_values(["x", "y"])
    y = got["y"].to_numpy()
    x = np.unpackbits(np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(y), -1), axis=1, count=len(vocabulary)).astype(np.float32)
    strength = x.sum(axis=1)
    cuts = np.quantile(strength[y == 1], np.arange(1, grades) / grades)
    return vocabulary, CumulativeLink(x, np.where(y == 1, 1 + np.searchsorted(cuts, strength, "right"), 0), grades)


def grade(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, p_toxic, severity, grade, toxic; with keep the rows of docs that aren't toxic, in its columns."""
    model = fit(docs, labels)
    names = docs.columns
    kept, text = with_text(docs) if keep else (docs.select("doc_id", F.col("text").cast("string")), "text")

    def run(batches):
        for batch in batches:
            parts = []
            for lo, hi, data, off in pieces(*utf8(batch.column(batch.schema.get_field_index(text)))):
                if model is None:
                    parts.append(np.zeros((hi - lo, GRADES)))
                    continue
                row, k = presence(data, off, model[0])
                once = np.unique(row * len(model[0]) + k)
                parts.append(model[1].from_sum(np.bincount(once // len(model[0]), model[1].w[once % len(model[0])], hi - lo)))
            above = np.concatenate(parts) if parts else np.zeros((0, GRADES))
            toxic = above[:, 0] >= 0.5
            if keep:
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(~toxic))
            else:
                exactly = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(exactly.argmax(axis=1).astype(np.int32)), pa.array(toxic)], ["doc_id", "p_toxic", "severity", "grade", "toxic"])

    if keep:
        return kept.mapInArrow(lean(run), docs.schema)
    return kept.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, p_toxic double, severity double, grade int, toxic boolean")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
