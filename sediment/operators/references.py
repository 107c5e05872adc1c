"""References whose target is missing, deleted or stored only later.

Keys are hashed to 128 bits. The first 64 bits, which are spread evenly whatever the keys look like, are cut into ranges.
Each range holds its parents as sorted arrays; batches of references are probed by vectorised binary search, and only misses
and late targets leave the task. A range whose references exceed ``probe_rows`` (a hot key) is split by a salt, its parents
going to every split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.session import parallelism

#: The states of a reference, by their code.
STATES = ("missing", "deleted", "late")


def hashed(kind: Column, key: Column) -> list[Column]:
    return [F.xxhash64(kind, key).alias("h1"), F.xxhash64(key, kind, F.lit(7)).alias("h2")]


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    order = np.lexsort((parents["h2"].to_numpy(), parents["h1"].to_numpy()))
    h1, h2 = parents["h1"].to_numpy()[order], parents["h2"].to_numpy()[order]
    named = parents["named"].to_numpy(zero_copy_only=False)[order]
    at = parents["at"].to_numpy(zero_copy_only=False)[order]  # NaN: named in the log only, or of unknown time
    if len(h1):  # one slot for each key: is it stored, since when, is it named in the log
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(first)
        gone = np.maximum.reduceat(named.astype(np.int8), starts).astype(bool)
        stored = np.maximum.reduceat((~named).astype(np.int8), starts).astype(bool)
        since = np.fmin.reduceat(np.where(named, np.nan, at), starts)
        h1, h2 = h1[starts], h2[starts]
    else:
        gone = stored = np.zeros(0, bool)
        since = np.zeros(0)
    r1, r2 = refs["h1"].to_numpy(), refs["h2"].to_numpy()
    pos = np.searchsorted(h1, r1)
    hit = np.zeros(len(r1), bool)
    while len(h1):  # keys that agree in the first half are walked together; nearly always one step
        safe = np.minimum(pos, len(h1) - 1)
        hit = (pos < len(h1)) & (h1[safe] == r1) & (h2[safe] == r2)
        walk = ~hit & (pos < len(h1)) & (h1[safe] == r1)
        if not walk.any():
            break
        pos = pos + walk
    safe = np.minimum(pos, max(len(h1) - 1, 0))
    pick = lambda a, miss: np.where(hit, a[safe], miss) if len(a) else np.full(len(r1), miss)
    is_stored, is_gone, from_time = pick(stored, False).astype(bool), pick(gone, False).astype(bool), pick(since, np.nan)
    created = refs["created_at"].to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        state = np.where(is_stored, np.where(from_time > created, 2, -1), np.where(is_gone, 1, 0)).astype(np.int8)
    return refs.select(["rec_id", "field", "created_at"]).append_column("state", pa.array(state)).filter(pa.array(state >= 0))


def find_broken(refs: DataFrame, parents: DataFrame, parent_rows: int = 100_000, probe_rows: int = 1_000_000) -> DataFrame:
    """Broken references.

    ``refs``: ``rec_id``, ``field``, ``kind``, ``key``, ``created_at``; ``parents``: ``kind``, ``key``, ``at`` (time since when
    it is stored) and ``named`` (true: not stored, but named as deleted). A key counts in its kind only. Returns ``rec_id``,
    ``field``, ``created_at`` and ``ref_status``: ``missing``, ``deleted`` or ``late`` (stored after the reference was made).

    Null and empty keys are no references and no parents. A parent without a time, or a reference without one, is never
    late. Repeated parents count once, with the earliest time; repeated references come out as often as they stand. Empty
    parents make every reference missing; empty references give an empty result. Columns of other names are ignored.
    """
    spark = refs.sparkSession
    refs = refs.where("key is not null and key <> ''").select("rec_id", "field", F.col("created_at").cast("double").alias("created_at"), *hashed(F.col("kind"), F.col("key")))
    parents = parents.where("key is not null and key <> ''").select(F.col("at").cast("double").alias("at"), F.coalesce("named", F.lit(False)).alias("named"), *hashed(F.col("kind"), F.col("key")))
    n_parents, n_refs = parents.count(), refs.count()
    bits = max(1, math.ceil(math.log2(max(2, parallelism(spark), n_parents / parent_rows, n_refs / probe_rows * 2))) + 1)
    in_range = (F.shiftrightunsigned(F.col("h1"), 64 - bits)).cast("int").alias("rng")
    refs, parents = refs.withColumn("rng", in_range), parents.withColumn("rng", in_range)
    crowded = refs.groupBy("rng").count().where(F.col("count") > probe_rows).select("rng", F.ceil(F.col("count") / probe_rows).cast("int").alias("splits")).collect()  # at most 2 ** bits rows
    splits = F.lit(1)
    if crowded:
        splits = F.coalesce(F.try_element_at(F.create_map(*(F.lit(int(x)) for r in crowded for x in (r.rng, r.splits))), F.col("rng")), F.lit(1))
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("rec_id", "field"), splits).cast("int"))
    parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1)))
    out = (
        refs.groupBy("rng", "salt")
        .cogroup(parents.groupBy("rng", "salt"))
        .applyInArrow(_probe, "rec_id string, field string, created_at double, state tinyint")
    )
    return out.select("rec_id", "field", "created_at", F.element_at(F.array(*map(F.lit, STATES)), F.col("state").cast("int") + 1).alias("ref_status"))
