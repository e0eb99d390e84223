"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the edges a, b (long; loops are ignored).

    Alternates two steps until the edges no longer change: each node sends its larger neighbours to the smallest of its
    neighbourhood, then each node sends its smaller neighbours there. Both are a minimum by key, which is summed before
    the shuffle and written, and an equi-join of two tables, so that the edges of a hub are shuffled for the join alone
    and Spark can split them; each round is written to the shared folder.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sign = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while before != (before := sign(now)) and before["n"]:
        pairs = both(now)
        least = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = pairs.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct())
    labels = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))
