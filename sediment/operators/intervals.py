"""Merging the overlapping periods of a key into continuous ones, and the gaps between them.

Two levels. A key with more than ``hot_rows`` rows is cut along time into shards at quantiles of its starts. Periods are
clipped at the shards' bounds; those that cover whole shards are counted per shard, not copied. Each shard is merged by
itself, then only the first and last piece of every shard go on to the stitch, where pieces that meet at a bound become one.
All other keys are one shard. Nothing but a shard's rows, or two rows a shard, is ever in one window group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.keys import OPEN
from sediment.session import hot_keys, small_side


def _islands(df: DataFrame, part: Sequence[str], same: bool) -> DataFrame:
    """Rows (part, s, e, shared, tag?) to islands, with the island's number in its group and the start of the next one."""
    w = Window.partitionBy(*part).orderBy("s", "e")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_reach", F.max("e").over(before))
    fresh: Column = F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))
    if same:
        fresh = fresh | (F.col("tag") != F.lag("tag").over(w))
    df = (
        df.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_shared", F.col("shared") | F.coalesce(F.col("s") < F.col("_reach"), F.lit(False)))
        .withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    aggs = [F.min("s").alias("s"), F.max("e").alias("e"), F.max("_shared").alias("shared")]
    if same:
        aggs.append(F.first("tag").alias("tag"))
    return df.groupBy(*part, "_island").agg(*aggs)


def merge_periods(df: DataFrame, keys: Sequence[str], same: bool = False, hot_rows: int = 500_000, shards: int = 64) -> DataFrame:
    """Merged periods of each key.

    ``df`` has the key columns, ``s`` and ``e`` (bigint, half-open, ``e > s``; OPEN for no end), ``shared`` (boolean: the row
    itself stands for records that share time) and, if ``same``, ``tag``: rows then merge only with an equal tag and must not
    overlap each other. Returns the keys, ``s``, ``e``, ``shared`` (two rows of the period share time), ``next_s`` (start of
    the key's next merged period, null for its last) and ``tag``.

    Periods that overlap or touch form one. Rows with null in a key or a bound are left out. Repeated rows count as records
    that share time; who wants them once drops them first. An empty input gives an empty result. Columns of other names are
    not carried; key columns may have any names but s, e, shared, tag, shard and those that begin with an underscore.
    """
    keys = list(keys)
    cols = [*keys, "s", "e", "shared", *(["tag"] if same else [])]
    df = df.select(*cols).dropna(subset=[*keys, "s", "e"])
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _with_next(_islands(df, keys, same), keys, same)
    cold = _with_next(_islands(df.join(hot, keys, "left_anti"), keys, same), keys, same)
    return cold.unionByName(_merge_hot(df.join(hot, keys, "left_semi"), keys, same, shards))


def _with_next(islands: DataFrame, part: Sequence[str], same: bool) -> DataFrame:
    w = Window.partitionBy(*part).orderBy("s", "e")
    out = islands.withColumn("next_s", F.lead("s").over(w))
    keys = [k for k in part if k != "shard"]
    return out.select(*keys, "s", "e", "shared", "next_s", *(["tag"] if same else []))


def _merge_hot(df: DataFrame, keys: list[str], same: bool, shards: int) -> DataFrame:
    quantiles = [i / shards for i in range(1, shards)]
    bounds = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("s", F.array(*map(F.lit, quantiles)), 10_000)).alias("_b"))
    at = lambda x: F.size(F.filter("_b", lambda b: b <= x))
    tag = ["tag"] if same else []
    df = df.join(small_side(bounds), keys).withColumn("_from", at(F.col("s"))).withColumn("_to", at(F.col("e") - 1))
    low = lambda i: F.when(i == 0, F.lit(-OPEN)).otherwise(F.get("_b", i - 1))
    high = lambda i: F.coalesce(F.get("_b", i), F.lit(OPEN))
    inside = df.where("_from = _to").select(*keys, F.col("_from").alias("shard"), "s", "e", "shared", *tag)
    across = df.where("_from < _to")
    heads = across.select(*keys, F.col("_from").alias("shard"), "s", high(F.col("_from")).alias("e"), "shared", *tag)
    tails = across.select(*keys, F.col("_to").alias("shard"), low(F.col("_to")).alias("s"), "e", "shared", *tag)
    # whole shards: first counted by the pair of ends, so that at most shards * shards rows are exploded for a key
    full = (
        across.where("_to - _from > 1")
        .groupBy(*keys, "_from", "_to", "_b", *tag)
        .agg(F.count("*").alias("_n"), F.max("shared").alias("shared"))
        .withColumn("shard", F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)))
        .groupBy(*keys, "shard", "_b", *tag)
        .agg(F.sum("_n").alias("_n"), F.max("shared").alias("shared"))
        .select(*keys, "shard", low(F.col("shard")).alias("s"), high(F.col("shard")).alias("e"), (F.col("shared") | (F.col("_n") > 1)).alias("shared"), *tag)
    )
    part = [*keys, "shard"]
    local = _islands(inside.unionByName(heads).unionByName(tails).unionByName(full), part, same)
    w = Window.partitionBy(*part).orderBy("s", "e")
    local = (
        local.withColumn("_i", F.row_number().over(w))
        .withColumn("_last", F.lead("s").over(w).isNull())
        .withColumn("next_s", F.lead("s").over(w))
    )
    inner = local.where((F.col("_i") > 1) & ~F.col("_last")).select(*keys, "s", "e", "shared", "next_s", *tag)
    # the stitch: at most two pieces a shard. A piece's local next start holds unless it is the last of its shard.
    edge = local.where((F.col("_i") == 1) | F.col("_last"))
    w = Window.partitionBy(*keys).orderBy("s", "e", "shard")
    edge = edge.withColumn("_reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))
    if same:
        fresh = fresh | (F.col("tag") != F.lag("tag").over(w))
    edge = edge.withColumn("_island", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy(*keys, "_island").agg(
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.max("shared").alias("shared"),
        F.max_by("next_s", F.struct("s", "e", "shard")).alias("_local_next"),
        *([F.first("tag").alias("tag")] if same else []),
    )
    w = Window.partitionBy(*keys).orderBy("s", "e")
    stitched = stitched.withColumn("next_s", F.coalesce("_local_next", F.lead("s").over(w))).select(*keys, "s", "e", "shared", "next_s", *tag)
    return inner.unionByName(stitched)


def periods_and_gaps(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``merged`` (see merge_periods) as rows of kind ``period`` and, before each next merged period, ``gap``."""
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("from_s"), F.col("e").alias("until_s"), F.col("shared").alias("shared")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("from_s"), F.col("next_s").alias("until_s"), F.lit(None).cast("boolean").alias("shared")),
    )
    return (
        merged.withColumn("_p", F.explode(pieces))
        .select(*keys, "_p.*")
        .where("kind = 'period' or (until_s is not null and until_s > from_s)")
    )
