"""The graph of entities and facts: degrees, orphans, duplicates, merging, deleting, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.session import cut


def endpoints(triples: DataFrame) -> DataFrame:
    """``id`` of each triple with each different endpoint: a loop counts once."""
    ends = F.array_distinct(F.array_compact(F.array("subject_id", "object_id")))
    return triples.select(F.col("id").alias("triple_id"), F.explode(ends).alias("entity_id"))


def degrees(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities with ``degree``, the number of their open triples."""
    d = endpoints(triples.where("valid_until is null")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    return entities.join(d, entities.id == d.entity_id, "left").drop("entity_id").fillna(0, ["degree"])


def orphans(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities that no triple names."""
    used = endpoints(triples).select(F.col("entity_id").alias("id"))
    return entities.join(used, "id", "left_anti")


def touched(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities that some triple names."""
    return entities.join(endpoints(triples).select(F.col("entity_id").alias("id")), "id", "left_semi")


def prefix_duplicates(entities: DataFrame) -> DataFrame:
    """Pairs of names of which one is the beginning of the other, whole tokens at a time or equal: ``key_a`` (shorter), ``key_b``, ``n_a``, ``n_b``.

    Works on different names, not on rows: equal names are one key with a count, so groups of copies make no pairs.
    """
    keys = entities.select(F.lower(F.trim("name")).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    words = F.split("key", " ")
    begin = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    longer = keys.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.explode(F.array_distinct(begin)).alias("key_a"))
    pairs = longer.join(keys.select(F.col("key").alias("key_a"), F.col("n").alias("n_a")), "key_a")
    return pairs.where("key_a <> key_b or n_a > 1").select("key_a", "key_b", "n_a", "n_b")


def merge_entities(entities: DataFrame, triples: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``alias``: ``id`` to ``keep``. Triples with merged ids replaced, entities without the merged ones."""
    a = alias.where("id <> keep").select("id", "keep").dropDuplicates(["id"])
    s, o = a.select(F.col("id").alias("subject_id"), F.col("keep").alias("_s")), a.select(F.col("id").alias("object_id"), F.col("keep").alias("_o"))
    t = triples.join(s, "subject_id", "left").join(o, "object_id", "left")
    t = t.withColumn("subject_id", F.coalesce("_s", "subject_id")).withColumn("object_id", F.coalesce("_o", "object_id")).select(triples.columns)
    return entities.join(a.select("id"), "id", "left_anti"), t


def same_names(entities: DataFrame) -> DataFrame:
    """``id`` to ``keep`` of entities with one name, case aside: the earliest, ties to the smaller id."""
    e = entities.select("id", F.lower(F.trim("name")).alias("key"), F.struct("created_at", "id").alias("o")).where("key <> ''")
    return e.join(e.groupBy("key").agg(F.min("o").alias("m")), "key").select("id", F.col("m.id").alias("keep"))


def neighbourhood(triples: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Triples within ``depth`` steps of the entities ``start`` (``id``), either way: ``triple_id`` and its smallest ``depth``.

    Each round joins the frontier, of different entities, to the links and leaves out those visited. The lineage is cut each round.
    """
    links = triples.select(F.col("id").alias("triple_id"), F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    both = links.select("triple_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.where("b is not null and b <> a").select("triple_id", F.col("b").alias("u"), F.col("a").alias("v")))
    seen = frontier = start.select("id").distinct()
    found = None
    for d in range(1, depth + 1):
        hit = cut(both.join(frontier.withColumnRenamed("id", "u"), "u"))
        step = hit.select("triple_id", F.lit(d).alias("depth")).distinct()
        found = step if found is None else found.unionByName(step)
        if d < depth:
            frontier = cut(hit.where("v is not null").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti"))
            seen = seen.unionByName(frontier)
    return found.groupBy("triple_id").agg(F.min("depth").alias("depth"))


def delete_entities(entities: DataFrame, triples: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without those in ``gone`` (``id``), and triples that name none of them."""
    g = gone.select("id").distinct()
    t = triples.join(g.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti").join(g.withColumnRenamed("id", "object_id"), "object_id", "left_anti")
    return entities.join(g, "id", "left_anti"), t.select(triples.columns)


def touch(entities: DataFrame, triples: DataFrame, ids: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """One access more for the triples in ``ids`` (``id``) and, once, for each entity that they name."""

    def bump(df: DataFrame, keys: DataFrame) -> DataFrame:
        j = df.join(keys.distinct().withColumn("_hit", F.lit(1)), "id", "left")
        j = j.withColumn("access_count", F.col("access_count") + F.coalesce("_hit", F.lit(0)))
        return j.withColumn("last_accessed", F.when(F.col("_hit").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed"))).select(df.columns)

    hit = triples.join(ids.select("id"), "id", "left_semi")
    return bump(entities, endpoints(hit).select(F.col("entity_id").alias("id"))), bump(triples, ids.select("id"))
