"""The full history of changing attributes, kept up to date from snapshots.

Records are reduced to one for each (key, start): the latest created. Keys are spread by a hash over the leaves of a tree; a
leaf's hash combines those of its rows, a branch's those of the leaves below it. A snapshot and its tree are stored. When
the next one comes, its tree is compared with the stored one from the root down, and only branches that differ are followed;
rows are read only for the leaves that differ, compared there key by key, and the versions of changed keys are built anew
and appended. All other keys keep the versions that are stored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.functions.keys import OPEN
from sediment.operators.intervals import merge_periods
from sediment.session import hot_keys, small_side

#: Bits of a leaf's number that each level of the tree adds; bits by which a snapshot's files are parted.
STEP, PARTS = 4, 4


def _spread(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _leaf(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("hk"), 64 - bits)


def merkle(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``rows``: the keys, ``hk`` (their hash), ``s``, ``e``, ``tag``. Nodes of the tree over 2 ** bits leaves, of which only those with rows exist: ``level`` (1 below the root), ``node``, ``h1``, ``h2``."""
    one = rows.select(_leaf(bits).alias("leaf"), F.xxhash64(*keys, "s", "e", "tag").alias("a"), F.xxhash64("tag", "e", "s", *keys, F.lit(1)).alias("b"))
    leaves = one.groupBy("leaf").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    node = lambda level: F.struct(F.lit(level).alias("level"), F.shiftrightunsigned("leaf", bits - STEP * level).alias("node"))
    up = F.explode(F.array(*(node(level) for level in range(1, bits // STEP + 1))))
    return leaves.select(up.alias("n"), F.xxhash64("leaf", "a").alias("a"), F.xxhash64("leaf", "b").alias("b")).groupBy("n.level", "n.node").agg(F.bit_xor("a").alias("h1"), F.bit_xor("b").alias("h2"))


def differing_leaves(old: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """Leaves (``leaf``) in which two trees of one depth differ: from the root down, of each level only the children of nodes that differ."""
    differing = None
    for level in range(1, bits // STEP + 1):
        a, b = (t.where(F.col("level") == level).select("node", "h1", "h2") for t in (old, new))
        if differing is not None:
            a, b = (t.join(differing, F.shiftrightunsigned(t.node, STEP) == differing.up, "left_semi") for t in (a, b))
        both = a.select("node", F.struct("h1", "h2").alias("was")).join(b.select("node", F.struct("h1", "h2").alias("now")), "node", "full")
        differing = both.where(~F.col("was").eqNullSafe(F.col("now"))).select(F.col("node").alias("up"))
    return differing.withColumnRenamed("up", "leaf")


def versions(records: DataFrame, keys: Sequence[str], hot_rows: int = 500_000) -> DataFrame:
    """Versions of each key from ``records``: the keys, ``s``, ``e`` (own end or OPEN) and ``tag`` (what the record says), one
    record for each key and start. A record holds until its own end or the next record's start; touching records that say
    the same are one version. Returns the keys, ``s``, ``e`` and ``tag``.
    """
    keys = list(keys)
    hot = hot_keys(records, keys, hot_rows)
    w = Window.partitionBy(*keys).orderBy("s")
    if hot is None:
        held = records.withColumn("e", F.least("e", F.coalesce(F.lead("s").over(w), F.lit(OPEN))))
    else:
        cold = records.join(hot, keys, "left_anti").withColumn("e", F.least("e", F.coalesce(F.lead("s").over(w), F.lit(OPEN))))
        rest = records.join(hot, keys, "left_semi")
        bounds = rest.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("s", F.array(*(F.lit(i / 64) for i in range(1, 64))), 10_000)).alias("_b"))
        rest = rest.join(small_side(bounds), keys).withColumn("_shard", F.size(F.filter("_b", lambda b: b <= F.col("s"))))
        first = rest.groupBy(*keys, "_shard").agg(F.min("s").alias("_first"))
        after = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_shard"))).select(*keys, "_shard", "_after")
        ws = Window.partitionBy(*keys, "_shard").orderBy("s")
        rest = rest.join(small_side(after), [*keys, "_shard"])
        rest = rest.withColumn("e", F.least("e", F.coalesce(F.lead("s").over(ws), F.col("_after"), F.lit(OPEN))))
        held = cold.unionByName(rest.select(cold.columns))
    held = held.select(*keys, "s", "e", "tag", F.lit(False).alias("shared"))
    return merge_periods(held, keys, same=True, hot_rows=hot_rows).select(*keys, "s", "e", "tag")


class HistoryStore:
    """A history under ``path``: ``snapshots/N`` and ``trees/N`` (those of the last update are needed), and ``versions/batch=N``, which are only appended to.

    ``leaf_rows``: rows a leaf should hold. An update that broke off leaves no tree and is written anew by the next one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], leaf_rows: int = 32, hot_rows: int = 500_000) -> None:
        self.spark, self.path, self.keys, self.leaf_rows, self.hot_rows = spark, path.rstrip("/"), list(keys), leaf_rows, hot_rows

    def _files(self, folder: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def batches(self) -> list[tuple[int, int]]:
        """Number and tree depth in bits of each complete update."""
        found = [tuple(map(int, name.split("-"))) for name in self._files("trees") if "_SUCCESS" in self._files(f"trees/{name}")]
        return sorted(found)

    def _snapshot(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/{n}")

    def update(self, records: DataFrame) -> int:
        """The next snapshot: ``records`` with the keys, ``created`` (double), ``s``, ``e`` (bigint, OPEN for none) and ``tag`` (bigint). Returns its number.

        Of several records with one start the latest created holds; ties go to the later end, then the larger tag. A null
        ``created`` counts as earliest. Rows with null in a key, a bound or the tag are left out; repeated rows count once;
        an empty snapshot ends the versions of all keys. Columns of other names are ignored.
        """
        keys, known = self.keys, self.batches()
        n = known[-1][0] + 1 if known else 0
        resolved = (
            records.dropna(subset=[*keys, "s", "e", "tag"]).groupBy(*keys, "s").agg(F.max(F.struct("created", "e", "tag")).alias("r"))
            .select(*keys, "s", "r.e", "r.tag", _spread(keys).alias("hk"))
            .withColumn("part", F.shiftrightunsigned("hk", 64 - PARTS).cast("int"))
        )
        resolved.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/snapshots/{n}")
        now = self.spark.read.schema(resolved.schema).parquet(f"{self.path}/snapshots/{n}")
        size = now.count()
        bits = min(60, max(STEP, STEP * math.ceil(math.log2(max(2, size / self.leaf_rows)) / STEP)))
        if known:
            last, depth = known[-1]
            bits = depth if depth <= bits <= depth + STEP else bits  # deeper only where the snapshot has outgrown its tree
        tree = f"trees/{n}-{bits}"
        rows = now
        if known:
            merkle(now, keys, bits).write.mode("overwrite").parquet(f"{self.path}/new-tree")
            new = self.spark.read.parquet(f"{self.path}/new-tree")
            before = self._snapshot(last) if self._files(f"snapshots/{last}") != ["_SUCCESS"] else now.limit(0)
            old = self.spark.read.parquet(f"{self.path}/trees/{last}-{depth}") if bits == depth else merkle(before, keys, bits)
            rows, gone = self._changed(before, now, differing_leaves(old, new, bits), bits)
            gone = gone.select(*keys, F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"), F.lit(None).cast("bigint").alias("tag"))
            built = versions(rows.select(*keys, "s", "e", "tag"), keys, self.hot_rows).unionByName(gone)
            built.write.mode("overwrite").parquet(f"{self.path}/versions/batch={n}")
            new.write.mode("overwrite").parquet(f"{self.path}/{tree}")
        else:
            versions(rows.select(*keys, "s", "e", "tag"), keys, self.hot_rows).write.mode("overwrite").parquet(f"{self.path}/versions/batch={n}")
            merkle(now, keys, bits).write.mode("overwrite").parquet(f"{self.path}/{tree}")
        return n

    def _changed(self, before: DataFrame, now: DataFrame, leaves: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
        """Rows now of keys that changed, and keys that are gone; reads only the leaves that differ."""
        leaves.write.mode("overwrite").parquet(f"{self.path}/differing")
        leaves = self.spark.read.parquet(f"{self.path}/differing")
        parts = [r[0] for r in leaves.select(F.shiftrightunsigned("leaf", bits - PARTS).cast("int")).distinct().collect()]  # at most 2 ** PARTS
        leaves = small_side(leaves)
        near = lambda rows: rows.where(F.col("part").isin(parts) if parts else F.lit(False)).join(leaves, _leaf(bits) == leaves.leaf, "left_semi")
        before, now = near(before), near(now)
        digest = lambda rows, sign: rows.select("hk", F.xxhash64(*self.keys, "s", "e", "tag").alias("h"), F.lit(sign).alias("w"))
        # a row that both have cancels itself out; what is left of a key's rows differs
        both = digest(before, 1).unionByName(digest(now, -1)).groupBy("hk").agg(F.bit_xor("h").alias("h"), F.sum("w").alias("w"))
        both.where("h <> 0 or w <> 0").select("hk").write.mode("overwrite").parquet(f"{self.path}/changed")
        changed = small_side(self.spark.read.parquet(f"{self.path}/changed"))
        rows = now.join(changed, "hk", "left_semi")
        gone = before.join(changed, "hk", "left_semi").select(*self.keys).distinct().join(rows.select(*self.keys), self.keys, "left_anti")
        return rows, gone

    def read(self) -> DataFrame:
        """The history as it stands: the keys, ``s``, ``e``, ``tag`` and ``batch`` (the update that brought the key's versions)."""
        known = self.batches()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.path}/versions/batch={known[-1][0]}").select(*self.keys).schema)
        h = self.spark.read.schema(f"{schema}, s bigint, e bigint, tag bigint, batch int").parquet(f"{self.path}/versions")
        newest = F.max("batch").over(Window.partitionBy(*self.keys))
        return h.where(F.col("batch") <= known[-1][0]).withColumn("_b", newest).where("batch = _b and s is not null").drop("_b")
