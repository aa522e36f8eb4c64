"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_of


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v, of one ordered type): root is the smallest node of its component.

    Each step sends a node's neighbours to its smallest one; steps are two aggregations and a join, and their
    number grows with the logarithm of the longest path. Each result is written to the shared folder.

    Defined cases: repeated edges count once; an edge from a node to itself or with a null end is left out; an empty
    table gives no rows; other columns are not read.
    """
    now = table_of(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = table_of(small.filter("u <> v").distinct(), "edges")
        told = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if told == before:
            break
        before = told
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
