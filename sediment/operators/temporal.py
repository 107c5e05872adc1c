"""Facts with periods of validity: supersession, as-of reads, conflicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(facts: DataFrame, at: float) -> DataFrame:
    """Facts valid at a time, half-open; a fact without a start never is."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def current(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_until").isNull())


def supersede(asserted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closes assertions by later ones.

    ``asserted``: the keys, ``seq`` (order of arrival), ``value``, ``valid_from`` and ``replaces``. A replacing assertion closes all earlier open
    ones of its keys with another value, at its own start; an equal value closes none. Adds ``valid_until``. Starts must not
    fall along ``seq`` (see split_by_order). Null keys form a key of their own; null values are equal to each other.
    """
    # rows after this one are those before it in the opposite order: a frame that grows from its start is filled in one pass, one that ends at the last row is filled anew for every row
    w, back = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("seq"), F.desc("seq")))
    nearest = lambda c, over: F.last(c, ignorenulls=True).over(over)
    rep = F.col("replaces")
    now = F.struct("value", "valid_from")
    df = asserted.withColumn("_before", nearest(F.when(rep, F.struct("value")), w))
    df = df.withColumn("_run", rep & (F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value"))))
    df = df.withColumn("_next", nearest(F.when(rep, now), back))
    # the next two runs of equal replacing values: the first may repeat this row's value, then the second closes it
    df = df.withColumn("_r1", nearest(F.when(F.col("_run"), now), back))
    df = df.withColumn("_after1", nearest(F.when(F.col("_run"), F.struct("valid_from", "seq", "_r1")), back))
    same = lambda c: c.eqNullSafe(F.col("value"))
    until = (
        F.when(F.col("_next").isNull(), None)
        .when(~same(F.col("_next.value")), F.col("_next.valid_from"))
        .when(same(F.col("_r1.value")) & F.col("_r1").isNotNull(), F.col("_after1._r1.valid_from"))
        .otherwise(F.col("_r1.valid_from"))
    )
    return df.withColumn("valid_until", until).drop("_next", "_before", "_run", "_r1", "_after1")


def split_by_order(asserted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Assertions of keys whose starts never fall along ``seq``, and those of all other keys."""
    w = Window.partitionBy(*keys).orderBy("seq")
    falls = F.coalesce(F.col("valid_from") < F.max("valid_from").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    df = asserted.withColumn("_f", falls)
    df = df.withColumn("_any", F.max("_f").over(Window.partitionBy(*keys)))
    return df.where(~F.col("_any")).drop("_f", "_any"), df.where("_any").drop("_f", "_any")


def _fold(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sequential supersession over rows sorted by key and seq; only the open rows of one key are held."""
    state_key, open_rows = None, []
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            key = tuple(row[k] for k in keys)
            if key != state_key:
                out += open_rows
                state_key, open_rows = key, []
            row |= {"valid_until": None, "rejected": False}
            clash = [r for r in open_rows if row["replaces"] and r["value"] != row["value"]]
            if any(r["valid_from"] > row["valid_from"] for r in clash):
                row["rejected"] = True
                out.append(row)
                continue
            for r in clash:
                r["valid_until"] = row["valid_from"]
                out.append(r)
            open_rows = [r for r in open_rows if r["valid_until"] is None] + [row]
        yield pd.DataFrame(out, columns=[*pdf.columns, "valid_until", "rejected"])
    if open_rows:
        yield pd.DataFrame(open_rows)


def supersede_any(asserted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As supersede, for starts in any order: an assertion older than an open one that it would close is ``rejected``. Adds ``valid_until``, ``rejected``.

    Keys in order take the window; only keys out of order are folded row by row, streamed in sorted partitions.
    """
    keys = list(keys)
    tidy, untidy = split_by_order(asserted, keys)
    fast = supersede(tidy, keys).withColumn("rejected", F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asserted.schema)
    slow = untidy.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(lambda it: _fold(it, keys), f"{fields}, valid_until double, rejected boolean")
    return fast.unionByName(slow)


def contradictions(facts: DataFrame, value: Column) -> DataFrame:
    """Open facts whose (subject_id, predicate) has more than one value: ``subject_id``, ``predicate``, ``n_values``, ``n_facts``."""
    open_ = current(facts).where("relation_type = 'fact'").withColumn("_v", value)
    return open_.groupBy("subject_id", "predicate").agg(F.count_distinct("_v").alias("n_values"), F.count("*").alias("n_facts")).where("n_values > 1")
