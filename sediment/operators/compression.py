"""The graph as text within a budget of tokens, in four tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.text import render_fact, token_estimate
from sediment.operators import spectral
from sediment.session import kept

#: Largest budgets of the tiers, and tokens that a fact takes on average.
TIERS, PER_FACT = ((50, "L0"), (200, "L1"), (2000, "L2")), 15


def tier(budget: int) -> str:
    return next((name for most, name in TIERS if budget <= most), "L3")


def opened(triples: DataFrame) -> tuple[DataFrame, spectral.Graph]:
    """The open facts, stored, and their graph: what all budgets have in common."""
    t = kept(triples.where("valid_until is null").select("id", "subject_id", "predicate", "object_id", "object_value", "relation_type", "confidence", "valid_until"), "open")
    return t, spectral.Graph(spectral.adjacency(t))


def ranked_facts(entities: DataFrame, t: DataFrame, graph: spectral.Graph, budget: int) -> DataFrame:
    """The ``budget`` // 15 most important open facts (see opened): ``pos``, ``text``, ``subject``, ``score``."""
    imp = spectral.importance(graph, budget)
    names = entities.select("id", "name")
    s = imp.select(F.col("id").alias("subject_id"), F.col("importance").alias("_a"))
    o = imp.select(F.col("id").alias("object_id"), F.col("importance").alias("_b"))
    t = t.join(s, "subject_id", "left").join(o, "object_id", "left")
    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.sqrt(F.col("_a") * F.col("_b"))).otherwise(F.coalesce("_a", "_b", F.lit(0.0)))
    t = t.withColumn("score", both * F.coalesce("confidence", F.lit(1.0)))
    top = t.orderBy(F.desc("score"), F.desc("confidence"), "id").limit(max(1, budget // PER_FACT))
    top = top.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")
    text = render_fact(F.col("subject"), F.col("predicate"), F.col("object_value"), F.col("object"), F.col("object_id"))
    pos = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("confidence"), "id"))  # of at most budget // 15 rows
    return top.select(pos.alias("pos"), text.alias("text"), "subject", "predicate", "score")


def compress(entities: DataFrame, triples: DataFrame, budget: int) -> DataFrame:
    """One row: ``tier``, ``budget``, ``text``, ``token_estimate``, ``n_lines``. Lines are taken in order of importance while the budget lasts."""
    return _compressed(entities, *opened(triples), budget)


def _compressed(entities: DataFrame, t: DataFrame, graph: spectral.Graph, budget: int) -> DataFrame:
    ranked = ranked_facts(entities, t, graph, budget)
    kind = tier(budget)
    line = {"L0": F.col("subject"), "L1": F.col("text")}.get(kind, F.concat(F.lit("- "), F.col("text")))
    lines = ranked.select("pos", line.alias("line")).where("line is not null")
    lines = lines.groupBy("line").agg(F.min("pos").alias("pos"))
    used = F.sum(token_estimate(F.col("line"))).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("used", used).where(F.col("used") <= budget)
    glue = ", " if kind == "L0" else "\n"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), glue)
    return lines.agg(text.alias("text"), F.coalesce(F.sum(token_estimate(F.col("line"))), F.lit(0)).alias("token_estimate"), F.count("*").alias("n_lines")).select(F.lit(kind).alias("tier"), F.lit(budget).alias("budget"), "text", "token_estimate", "n_lines")


def budget_report(entities: DataFrame, triples: DataFrame, budgets: tuple[int, ...] = (50, 200, 2000, 10_000)) -> DataFrame:
    out, (t, graph), names = None, opened(triples), kept(entities.select("id", "name"), "names")
    for b in budgets:
        row = _compressed(names, t, graph, b).withColumn("preview", F.substring("text", 1, 100)).drop("text")
        out = row if out is None else out.unionByName(row)
    return out
