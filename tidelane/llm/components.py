"""Connected components of a large graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import release, stored


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge in ``edges`` (a, b).

    Each round hangs the neighbours of a node on the smallest of them, first those above the node, then those
    below; it ends when the edges no longer change, which takes about the logarithm of the longest path. A
    node's smallest neighbour is found by a partial aggregation and joined back, so that a node with
    millions of neighbours is no task's burden. Rounds are cut by written tables.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").select("a", F.col("m").alias("b")))
        large = stored(large.where("a <> b").distinct(), name)
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("a", F.col("m").alias("b")))
        last, now = now, stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        release(last, large)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
