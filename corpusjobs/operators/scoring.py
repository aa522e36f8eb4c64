"""Scoring of tokens by a model that a Python worker loads once, in batches: class probabilities of feature arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

BATCH = 4096


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def linear(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable]:
    """What makes a predict function of a linear model: logits are features times weights (a row a class) and the bias."""

    def load() -> Callable:
        w, b = np.asarray(weights, float), np.asarray(bias, float)
        return lambda features: softmax(np.asarray(features, float) @ w.T + b)

    return load


def from_file(path: str) -> Callable[[], Callable]:
    """The same of a model in a folder that all workers share: an .npz file with weights and bias, read once by each worker."""

    def load() -> Callable:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(name) as file, np.load(file) as x:
            return linear(x["weights"], x["bias"])()

    return load


def probabilities(rows: DataFrame, features: Column, size: int, load: Callable[[], Callable], batch: int = BATCH) -> DataFrame:
    """rows with probs: an array of a probability for each class.

    load() is called once in a worker and gives a function of a batch's features (rows by size). Features that are null
    count as zeros.
    """
    score = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[size]])
    filled = F.coalesce(F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), size))
    return rows.withColumn("probs", score(filled))


def class_probabilities(rows: DataFrame, classes: list[str], least: float = 0.0) -> DataFrame:
    """rows with probs as a map from class to probability, of those of at least `least`."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, classes)), F.col("probs"))
    return rows.withColumn("probs", F.map_filter(pairs, lambda _, p: p >= least))


def best_class(rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows with pred and p: the likeliest class, the first of equal ones."""
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return rows.withColumn("pred", F.element_at(F.array(*map(F.lit, classes)), best)).withColumn("p", F.array_max("probs")).drop("probs")
