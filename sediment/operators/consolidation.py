"""Consolidation of the graph: promote repeated facts, clean, decay, prune, regroup. Snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators import graph, spectral
from sediment.session import cut

FACT = ["subject_id", "predicate", "object_id", "object_value"]


def promote_repeated(triples: DataFrame, least: int = 3, factor: float = 1.5) -> DataFrame:
    """Confidence of open facts that at least ``least`` different sources state, times ``factor``, at most 1."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in FACT]
    t = triples.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in FACT})
    many = triples.where("valid_until is null").groupBy(*key).agg(F.count_distinct("source_ref").alias("_n")).where(F.col("_n") >= least).drop("_n").withColumn("_up", F.lit(True))
    t = t.join(many, [f"_{c}" for c in FACT], "left")
    up = F.col("_up").isNotNull() & F.col("valid_until").isNull()
    return t.withColumn("confidence", F.when(up, F.least(F.col("confidence") * factor, F.lit(1.0))).otherwise(F.col("confidence"))).select(triples.columns)


def drop_self_references(triples: DataFrame) -> DataFrame:
    return triples.where(~(F.col("valid_until").isNull() & F.col("object_id").eqNullSafe(F.col("subject_id"))))


def dedup_triples(triples: DataFrame) -> DataFrame:
    """Of equal open triples the most confident, then the latest, then the smallest id stays; closed ones all stay."""
    open_ = triples.where("valid_until is null")
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)), "created_at")
    best = open_.groupBy(*FACT, "relation_type").agg(F.max(order).alias("_o"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*FACT, "relation_type"]]
    kept = open_.withColumn("_o", order).alias("l").join(best.alias("r"), [*same, F.col("l._o") == F.col("r._o")], "left_semi")
    first = kept.groupBy(*FACT, "relation_type").agg(F.min_by(F.struct(*triples.columns), "id").alias("t")).select("t.*")
    return first.unionByName(triples.where("valid_until is not null"))


def apply_decay(entities: DataFrame, triples: DataFrame, decayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with their new confidence where it moved by more than 0.01; open triples by the ratio of each such endpoint, the smaller id first, within [0, 1] after each."""
    moved = decayed.where("abs(new_confidence - confidence) > 0.01").select("id", "new_confidence", (F.col("new_confidence") / F.greatest("confidence", F.lit(0.01))).alias("f"))
    e = entities.join(moved.select("id", "new_confidence"), "id", "left").withColumn("confidence", F.coalesce("new_confidence", "confidence")).select(entities.columns)
    lo, hi = F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")
    t = triples.withColumn("_lo", F.when(F.col("object_id").isNull(), F.col("subject_id")).otherwise(lo)).withColumn("_hi", F.when(F.col("object_id").isNotNull() & (F.col("object_id") != F.col("subject_id")), hi))
    f = moved.select("id", "f")
    t = t.join(f.select(F.col("id").alias("_lo"), F.col("f").alias("_f1")), "_lo", "left").join(f.select(F.col("id").alias("_hi"), F.col("f").alias("_f2")), "_hi", "left")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    c1 = F.when(F.col("_f1").isNull(), F.col("confidence")).otherwise(clamp(F.col("confidence") * F.col("_f1")))
    c2 = F.when(F.col("_f2").isNull(), c1).otherwise(clamp(c1 * F.col("_f2")))
    return e, t.withColumn("confidence", F.when(F.col("valid_until").isNull(), c2).otherwise(F.col("confidence"))).select(triples.columns)


def prune(triples: DataFrame, below: float, now: float) -> DataFrame:
    """Open facts of a confidence below ``below`` are closed now."""
    gone = F.col("valid_until").isNull() & (F.col("relation_type") == "fact") & (F.col("confidence") < below)
    return triples.withColumn("valid_until", F.when(gone, F.lit(now)).otherwise(F.col("valid_until")))


def consolidate(entities: DataFrame, triples: DataFrame, now: float, below: float = 0.05, half_life_days: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """All phases in their order: promotion, merging of same names, self references, duplicates, orphans, decay, pruning."""
    entities, t = cut(entities), promote_repeated(triples)
    e, t = graph.merge_entities(entities, t, graph.same_names(entities))
    t = cut(dedup_triples(drop_self_references(t)))
    e = cut(e.join(graph.touched(e, t).select("id"), "id", "left_semi"))
    e, t = apply_decay(e, t, cut(spectral.decay_operator(e, spectral.adjacency(t), now, half_life_days)))
    return e, prune(t, below, now)


def centroids(members: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``members``: ``cluster_id``, ``id``; ``vectors``: ``id``, ``vec``. Mean vector of each cluster: ``cluster_id``, ``n``, ``centroid``."""
    from sediment.functions.vectors import usable

    v = vectors.where(usable(F.col("vec"), dim)).dropDuplicates(["id"])
    parts = members.join(v, "id").select("cluster_id", F.posexplode("vec").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def graph_stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row of counts."""
    e = entities.agg(F.count("*").alias("n_entities"))
    t = triples.agg(F.count_if(F.col("valid_until").isNull()).alias("n_open"), F.count_if(F.col("valid_until").isNotNull()).alias("n_closed"), F.count_if(F.col("object_id").isNotNull()).alias("n_edges"))
    return e.crossJoin(F.broadcast(t))


def cooccurrence(items: DataFrame, reach: int = 5) -> DataFrame:
    """``items``: ``grp``, ``names`` (array). Pairs of different names less than ``reach`` places apart: ``a`` < ``b``, ``n`` groups' worth of times. Linear in the places."""
    pos = items.select("grp", F.col("names").alias("_n"), F.posexplode("names").alias("i", "x"))
    near = pos.select("x", F.explode(F.slice("_n", F.col("i") + 2, F.lit(reach - 1))).alias("y")).where("x <> y")
    return near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def rank_in_budget(rows: DataFrame, by: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows of each group in order while their running size stays within ``budget``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
