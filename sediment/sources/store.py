"""Versioned snapshots of tables: each version is a folder, the manifest names the current one and is replaced by an atomic rename."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under ``root``, kept apart by ``scope`` (one folder each). Works on any file system with an atomic rename."""

    def __init__(self, spark: SparkSession, root: str, scope: str = "global") -> None:
        if not scope or "/" in scope or scope.startswith("."):
            raise ValueError("a scope is a plain name")
        self.spark, self.base = spark, f"{root.rstrip('/')}/{scope}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict[str, int]:
        p = self._path(f"{self.base}/manifest.json")
        if not self._fs.exists(p):
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(p.toString()).collect()))

    def versions(self) -> dict[str, int]:
        return self._manifest()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        v = self._manifest()[name] if version is None else version
        return self.spark.read.parquet(f"{self.base}/{name}/v={v}")

    def publish(self, **tables: DataFrame) -> dict[str, int]:
        """Writes the next version of each table, then publishes all at once. A failed write leaves the published ones as they were."""
        now = self._manifest()
        new = dict(now)
        for name, df in tables.items():
            new[name] = now.get(name, 0) + 1
            df.write.mode("overwrite").parquet(f"{self.base}/{name}/v={new[name]}")
        draft = self._path(f"{self.base}/manifest.json.new")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.base).toUri() if "://" in self.base else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(draft, self._path(f"{self.base}/manifest.json"), array)
        return new

    def compact(self, name: str, files: int) -> None:
        """Rewrites a table into ``files`` files as its next version."""
        self.publish(**{name: self.read(name).repartition(files)})

    def drop_old(self, name: str, keep: int = 2) -> int:
        """Deletes all but the ``keep`` newest published versions; returns how many went."""
        top, gone = self._manifest()[name], 0
        for v in range(1, top - keep + 1):
            gone += bool(self._fs.delete(self._path(f"{self.base}/{name}/v={v}"), True))
        return gone

    def size(self) -> int:
        """Bytes on disk."""
        p = self._path(self.base)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0


def integrity(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """``problem``, ``n``: ends that are not stored, relations outside the known kinds, both or neither object, confidence outside [0, 1]."""
    from sediment.operators.spectral import WEIGHTS

    ids = entities.select("id").distinct()
    lost = lambda c: triples.where(f"{c} is not null").join(ids.withColumnRenamed("id", c), c, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"lost_{c}").alias("problem"), "n")
    checks = triples.agg(
        F.count_if(~F.col("relation_type").isin(*WEIGHTS)).alias("relation"),
        F.count_if(F.col("object_id").isNull() == F.col("object_value").isNull()).alias("object"),
        F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidence"),
    )
    rest = checks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in checks.columns))).alias("x")).select("x.*")
    return lost("subject_id").unionByName(lost("object_id")).unionByName(rest)


def usage(messages: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: rows of each table, bytes of message text and of embeddings."""
    m = messages.agg(F.count("*").alias("n_messages"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("text_bytes"))
    e = entities.agg(F.count("*").alias("n_entities"), F.coalesce(F.sum(F.when(F.col("embedding").isNotNull(), F.size("embedding") * 4)), F.lit(0)).cast("bigint").alias("vector_bytes"))
    t = triples.agg(F.count("*").alias("n_triples"))
    return m.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(t))


def backup(source: Store, to: Store) -> dict[str, int]:
    """Copies the published tables of one store into an empty one and checks the row counts before they are published there."""
    if to.versions():
        raise ValueError("the target is not empty")
    tables = {name: source.read(name) for name in source.versions()}
    made = to.publish(**tables)
    for name, df in tables.items():
        if df.count() != to.read(name).count():
            raise RuntimeError(f"{name}: rows differ")
    return made
