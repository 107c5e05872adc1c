"""Session settings and the few helpers that every operator shares."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sediment", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer. Settings given in ``conf`` win (``__`` for a dot)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir`` or, only in local mode and only if unset, one of our own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), f"sediment-checkpoint-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, in the shared folder for checkpoints."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage as cut does, by a compressed table in the shared folder: many rows take less of it than in a checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted, not guessed); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, however many there are, to join with: broadcast only if they are few (see small_side). None if no key is hot."""
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    return small_side(hot) if hot.take(1) else None


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it wherever they run. The archive lies in the checkpoint folder, which all share."""
    sc = spark.sparkContext
    if getattr(sc, "_sediment_shipped", False):
        return
    root, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("sediment", os.path.relpath(path, root)))
    to = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{sc.applicationId}/sediment.zip")
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(to.toString())
    sc._sediment_shipped = True
