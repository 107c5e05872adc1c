"""Connected components by alternating stars: links are turned towards the smallest node until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges``: ``a``, ``b`` (one type, ordered). Returns ``node`` and ``component`` (its smallest node) of all nodes with a link.

    Each round keeps at most one row for a pair and turns every link to the smallest neighbour, so no row is made for pairs
    inside a group. More than ``max_rounds`` rounds are an error. Nulls and links of a node to itself are ignored, repeated links count once, no links give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, state = cut(e), None
    for _ in range(max_rounds):
        n = _both(e)
        least = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = n.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError(f"the components are not found after {max_rounds} rounds, which is far beyond the square of the logarithm of any number of links")
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
