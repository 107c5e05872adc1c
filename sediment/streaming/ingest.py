"""Live ingestion: supersession kept as state for each (subject, predicate), and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "subject_id string, predicate string, value string, valid_from double, valid_until double, status string"
STATE = "value string, valid_from double"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["valid_from", "value"], kind="stable")
    held = state.get if state.exists else None
    out = []
    for value, start in zip(rows["value"], rows["valid_from"], strict=True):
        if held is None:
            held = (value, float(start))
        elif start < held[1]:
            out.append((*key, value, float(start), None, "late"))
        elif value != held[0]:
            out.append((*key, held[0], held[1], float(start), "closed"))
            held = (value, float(start))
    state.update(held)
    yield pd.DataFrame(out, columns=["subject_id", "predicate", "value", "valid_from", "valid_until", "status"])


def live_supersession(stream: DataFrame) -> DataFrame:
    """A stream of ``subject_id``, ``predicate``, ``value``, ``valid_from`` to closed versions; what is older than the open version comes out as ``late``.

    The state of a key is its open version only. Rows without a subject, predicate, value or start are left out.
    """
    s = stream.select("subject_id", "predicate", "value", F.col("valid_from").cast("double").alias("valid_from")).dropna()
    return s.groupBy("subject_id", "predicate").applyInPandasWithState(_step, OUT, STATE, "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts for each key and window, closed once the watermark passes; later rows are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def append_new(stream: DataFrame, path: str, checkpoint: str):
    """Messages to a table, each id once even if a batch is run again: a batch goes to a folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
