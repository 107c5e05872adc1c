"""Measures of ranked answers against what is relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_any(ranked: Column, gold: Column, k: int) -> Column:
    """1 if one of the gold ids is among the first ``k``; 0 without gold."""
    return F.coalesce(F.arrays_overlap(F.slice(ranked, 1, k), gold), F.lit(False)).cast("double")


def recall_all(ranked: Column, gold: Column, k: int) -> Column:
    """1 if all of the gold ids are among the first ``k``; 0 without gold."""
    return F.coalesce((F.size(gold) > 0) & (F.size(F.array_except(gold, F.slice(ranked, 1, k))) == 0), F.lit(False)).cast("double")


def _gain(ranked: Column, gold: Column, k: int, discount) -> Column:
    hits = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / discount(i)).otherwise(0.0))
    return F.aggregate(hits, F.lit(0.0), lambda a, b: a + b)


def _ideal(n: Column, discount) -> Column:
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: 1.0 / discount(i - 1)), F.lit(0.0), lambda a, b: a + b)


def ndcg(ranked: Column, gold: Column, k: int) -> Column:
    """Rank 1 not discounted, rank r by log2(r); the ideal has min(gold, k) hits. 0 without gold."""
    d = lambda i: F.when(i == 0, 1.0).otherwise(F.log2(i + 1))
    n = F.least(F.size(gold), F.lit(k))
    return F.when(n > 0, _gain(ranked, gold, k, d) / _ideal(F.greatest(n, F.lit(1)), d)).otherwise(0.0)


def ndcg_retrieved(ranked: Column, gold: Column, k: int) -> Column:
    """Every rank discounted by log2(rank + 1); the ideal puts the hits retrieved first. 0 without hits."""
    d = lambda i: F.log2(i + 2)
    n = F.size(F.array_intersect(F.slice(ranked, 1, k), gold))
    return F.when(n > 0, _gain(ranked, gold, k, d) / _ideal(F.greatest(n, F.lit(1)), d)).otherwise(0.0)


def bundle(runs: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``runs``: ``qid``, ``ranked``, ``gold`` (arrays). All measures at each k."""
    cols = {}
    for k in ks:
        cols |= {f"recall_any_{k}": recall_any(F.col("ranked"), F.col("gold"), k), f"recall_all_{k}": recall_all(F.col("ranked"), F.col("gold"), k), f"ndcg_{k}": ndcg(F.col("ranked"), F.col("gold"), k)}
    return runs.withColumns(cols)


def compare(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Full join of two runs: value in each, difference, and on which side it is missing."""
    j = a.select(*keys, F.col(metric).alias("value_a")).join(b.select(*keys, F.col(metric).alias("value_b")), keys, "full")
    state = F.when(F.col("value_a").isNull(), "only_b").when(F.col("value_b").isNull(), "only_a").when(F.col("value_a") == F.col("value_b"), "equal").otherwise("differs")
    return j.withColumn("delta", F.col("value_b") - F.col("value_a")).withColumn("state", state)
