"""Nearest vectors by an index: inverted lists around centres, searched in a query's nearest lists alone.

Centres are fitted by spherical k-means on at most `SAMPLE` vectors, those with the least hashes of their ids; every vector
is put into the list of its nearest centre. A query is compared exactly with all vectors of its `probes` nearest lists; how many
these are is told by at most `TRIED` queries, whose true neighbours one pass finds: as many as hold `TARGET` of those.
Equal vectors stand in a list once. Lists are cut into blocks and a list's queries into shares, so no list, however long
or asked for, meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_LISTS, BLOCK, ASKED, ROUNDS = 20_000, 2048, 4096, 2048, 8
TRIED, TARGET = 100, 0.97


def _units(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres (a row each), as many as the root of the number of vectors, MOST_LISTS at most; at most `sample` vectors are looked at."""
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(vectors.count())))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(rows):
        return np.zeros((0, 0))
    x = _units(rows)
    found = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.maximum(size, 1e-12), found)
    return found


def nearest_lists(vectors: DataFrame, found: np.ndarray, probes: int) -> DataFrame:
    """vec_id, embedding, lists: the numbers of each vector's nearest centres, nearest first."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-(_units(batch.column(1)) @ found.T), axis=1, kind="stable")[:, :probes]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel().astype(np.int32)), order.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "embedding", "lists"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {dict(vectors.dtypes)['embedding']}, lists array<int>")


def probes_for(own: DataFrame, asked: DataFrame, found: np.ndarray, k: int, target: float = TARGET, tried: int = TRIED) -> int:
    """How many lists a query has to look into to find `target` of its k neighbours: own has vec_id, embedding and list.

    At most `tried` queries are compared with all vectors, in one pass; a task hands on k rows for each.
    """
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(tried).select("vec_id", "embedding").toArrow().combine_chunks()
    if not rows.num_rows:
        return 1
    asked_ids, x = np.asarray(rows["vec_id"].combine_chunks()), _units(rows["embedding"].combine_chunks())
    place = np.argsort(np.argsort(-(x @ found.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order

    def run(batches):
        best = np.zeros((len(x), 0, 2))  # cosine and list
        for batch in batches:
            if batch.num_rows:
                cosine = np.round(x @ _units(batch.column(1)).T, 6)
                cosine[(asked_ids[:, None] == np.asarray(batch.column(0))) | (cosine > 0.9999995)] = -np.inf
                both = np.concatenate([best, np.stack([cosine, np.broadcast_to(np.asarray(batch.column(2)), cosine.shape)], axis=2)], axis=1)
                order = np.argsort(-both[..., 0], axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(both, order[..., None], axis=1)
        query = np.repeat(np.arange(len(x)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[..., 0].ravel()), pa.array(best[..., 1].ravel().astype(np.int32))], ["q", "cosine", "list"])

    met = own.select("vec_id", "embedding", "list").mapInArrow(run, "q long, cosine double, list int").filter("cosine > -1.5")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "list"))
    told = met.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "list").collect()  # k a tried query
    needed = sorted(place[r["q"], r["list"]] + 1 for r in told)
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) if needed else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 3, probes: int | None = None, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, rank, neighbour, cosine (6 digits): the k nearest vectors to each query (vec_id, embedding) that differ from it.

    probes: how many lists are looked into, by default as many as probes_for() tells.
    Of equal vectors the one with the smallest id stands for all. Zero and null vectors are no neighbours and have none;
    ties go to the smallest id.
    """
    real = F.exists("embedding", lambda x: x != 0)
    given = vectors.filter(real).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    asked = queries.filter(real).select("vec_id", "embedding")
    found = centres(vectors.filter(real), lists, sample)
    schema = "vec_id long, neighbour long, cosine double"
    if not len(found):
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank long, neighbour long, cosine double")
    own = nearest_lists(given, found, 1).select("vec_id", "embedding", F.col("lists")[0].alias("list"))
    probes = probes or probes_for(own, asked, found, k)
    to = nearest_lists(asked, found, probes).select("vec_id", "embedding", F.explode("lists").alias("list"))
    blocks = own.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a list, MOST_LISTS at most
    shares = to.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares"))
    sizes = F.broadcast(blocks.join(shares, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    own = own.join(sizes, "list").select("vec_id", "embedding", "list", at("blocks").alias("block"), every("shares").alias("share"))
    to = to.join(sizes, "list").select("vec_id", "embedding", "list", at("shares").alias("share"), every("blocks").alias("block"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        ids, others = (np.asarray(t["vec_id"].combine_chunks()) for t in (left, right))
        x, y = (_units(t["embedding"].combine_chunks()) for t in (left, right))
        cosine = np.round(x @ y.T, 6)
        for i, j in zip(*np.nonzero(cosine > 0.999999 - 1e-9)):
            if left["embedding"][int(i)] == right["embedding"][int(j)]:
                cosine[i, j] = -np.inf
        order = np.lexsort((np.broadcast_to(others, cosine.shape), -cosine), axis=1)[:, :k]
        value = np.take_along_axis(cosine, order, 1).ravel()
        kept = value > -np.inf
        return pa.table({"vec_id": np.repeat(ids, order.shape[1])[kept], "neighbour": others[order.ravel()][kept], "cosine": value[kept]})

    keys = ["list", "block", "share"]
    met = to.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")).cast("long")
    return met.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (vec_id, neighbour) that were found."""
    both = exact.select("vec_id", "neighbour").join(found.select("vec_id", "neighbour").withColumn("hit", F.lit(1)), ["vec_id", "neighbour"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
