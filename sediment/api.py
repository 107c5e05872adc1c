"""The engine as one object: a scope's messages, entities and facts in a versioned store, and what can be asked of them.

Every call works on whole tables; what changes them publishes new versions at once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.text import render_fact
from sediment.operators import compression, consolidation, graph, ingest, retrieval, spectral, temporal
from sediment.sources import archive, store

MESSAGES = "id string, timestamp double, role string, content string, session_id string, metadata string"
ENTITIES = "id string, name string, entity_type string, created_at double, confidence double, access_count bigint, last_accessed double, embedding array<float>"
TRIPLES = (
    "id string, subject_id string, predicate string, object_id string, object_value string, relation_type string, confidence double, valid_from double, valid_until double, source_ref string, "
    "created_at double, last_accessed double, access_count bigint"
)


class Memory:
    """Messages, entities and facts of one scope under ``root``. ``quota``: bytes beyond which nothing is stored."""

    def __init__(self, spark: SparkSession, root: str, scope: str = "global", quota: int | None = None) -> None:
        self.spark, self.store, self.quota = spark, store.Store(spark, root, scope), quota
        if not self.store.versions():
            self.store.publish(messages=spark.createDataFrame([], MESSAGES), entities=spark.createDataFrame([], ENTITIES), triples=spark.createDataFrame([], TRIPLES))

    @property
    def messages(self) -> DataFrame:
        return self.store.read("messages")

    @property
    def entities(self) -> DataFrame:
        return self.store.read("entities")

    @property
    def triples(self) -> DataFrame:
        return self.store.read("triples")

    @property
    def quarantine(self) -> DataFrame:
        """Facts that were not taken, as they are older than an open fact that they would close."""
        return self.store.read("quarantine") if "quarantine" in self.store.versions() else self.spark.createDataFrame([], TRIPLES)

    def remember(self, messages: DataFrame) -> dict[str, int]:
        """Stores a batch of messages (known ids are skipped), extracts names and facts, resolves and supersedes them. Facts that come too late go to the quarantine."""
        if self.quota is not None and self.store.size() >= self.quota:
            raise RuntimeError("the store is full")
        cols = self.messages.columns
        new = messages.where("id is not null and trim(content) <> ''").dropDuplicates(["id"]).select(cols).join(self.messages.select("id"), "id", "left_anti").select(cols).cache()
        ex = ingest.extract(new)
        said = ingest.assertions(ex).cache()
        names = ex.select(F.explode("names").alias("name"), "timestamp").unionByName(said.select(F.col("subject_key").alias("name"), F.col("valid_from").alias("timestamp")))
        resolved = ingest.resolve(names.select("name", F.lit(None).cast("string").alias("entity_type"), F.col("timestamp").alias("at")), self.entities).cache()
        fresh = resolved.where("is_new").select("id", "name", "entity_type", "created_at", F.lit(1.0).alias("confidence"), F.lit(0).cast("bigint").alias("access_count"), F.lit(None).cast("double").alias("last_accessed"), F.lit(None).cast("array<float>").alias("embedding"))
        key = resolved.select("name_key", "id")
        t = said.join(key.select(F.col("name_key").alias("subject_key"), F.col("id").alias("subject_id")), "subject_key").join(key.select(F.col("name_key").alias("object_key"), F.col("id").alias("_o")), "object_key", "left")
        t = t.select(
            F.sha2(F.concat_ws("|", "source_ref", "subject_key", "predicate", "object_key"), 256).alias("id"), "subject_id", "predicate", F.when(F.col("links"), F.col("_o")).alias("object_id"),
            F.when(~F.col("links") | F.col("_o").isNull(), F.col("object_key")).alias("object_value"), F.lit("fact").alias("relation_type"), F.lit(0.5).alias("confidence"), "valid_from", F.lit(None).cast("double").alias("valid_until"),
            "source_ref", F.col("valid_from").alias("created_at"), F.lit(None).cast("double").alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"),
        )
        t = t.dropDuplicates(["id"]).join(self.triples.select("id"), "id", "left_anti").select(self.triples.columns)
        # only the keys that the batch touches are derived again
        touched = t.select("subject_id", "predicate").distinct()
        old = self.triples.where("valid_until is null and relation_type = 'fact'").join(touched, ["subject_id", "predicate"], "left_semi").select(t.columns)
        from pyspark.sql import Window

        seq = F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy("created_at", "id"))
        value = F.coalesce(F.concat(F.lit("i:"), F.col("object_id")), F.concat(F.lit("v:"), F.col("object_value")))
        rows = old.unionByName(t).drop("valid_until").withColumn("value", value).withColumn("seq", seq).withColumn("replaces", ~F.lower("predicate").isin(*ingest.ADDITIVE))
        done = temporal.supersede_any(rows, ["subject_id", "predicate"])
        late, done = done.where("rejected").select(t.columns), done.where("not rejected").select(t.columns)
        rest = self.triples.join(old.select("id"), "id", "left_anti").select(t.columns)
        made = self.store.publish(messages=self.messages.unionByName(new), entities=self.entities.unionByName(fresh), triples=rest.unionByName(done), quarantine=self.quarantine.unionByName(late))
        for x in (new, said, resolved):
            x.unpersist()
        return made

    def facts(self, as_of: float | None = None) -> DataFrame:
        """Facts as text, open ones or those valid at ``as_of``."""
        t = temporal.current(self.triples) if as_of is None else temporal.as_of(self.triples, as_of)
        n = self.entities.select("id", "name")
        t = t.join(n.select(F.col("id").alias("subject_id"), F.col("name").alias("_s")), "subject_id", "left").join(n.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left")
        return t.withColumn("text", render_fact(F.col("_s"), F.col("predicate"), F.col("object_value"), F.col("_o"), F.col("object_id"))).drop("_s", "_o")

    def recall(self, queries: DataFrame, now: float, k: int = 10, mode: str = "balanced", as_of: float | None = None) -> DataFrame:
        """``queries``: ``qid``, ``text``. The best facts for each: ``qid``, ``pos``, ``id``, ``text``, ``score``, ``valid_until``, and the message they come from."""
        f = self.facts(as_of)
        t = self.triples if as_of is None else temporal.as_of(self.triples, as_of).withColumn("valid_until", F.lit(None).cast("double"))
        top = retrieval.recall(self.entities, t, f, queries, now if as_of is None else as_of, k, mode)
        return top.join(f.select("id", "text", "valid_until", "source_ref"), "id").join(self.messages.select(F.col("id").alias("source_ref"), F.col("content").alias("source")), "source_ref", "left")

    def touch(self, results: DataFrame, now: float) -> dict[str, int]:
        """Counts an access of the facts in ``results`` (``id``) and, once, of each entity that they name."""
        e, t = graph.touch(self.entities, self.triples, results, now)
        return self.store.publish(entities=e, triples=t)

    def history(self, name: str, predicate: str | None = None) -> DataFrame:
        e = self.entities.where(F.lower(F.trim("name")).startswith(name.strip().lower())).select(F.col("id").alias("subject_id"))
        t = self.triples.join(e, "subject_id", "left_semi")
        return (t.where(F.col("predicate") == predicate) if predicate else t).orderBy("created_at", "id")

    def entity_context(self, name: str) -> dict[str, DataFrame]:
        """Open facts of the entities of a name, facts that point at them, and all versions."""
        e = self.entities.where(F.lower(F.trim("name")) == name.strip().lower()).select("id")
        of = self.triples.join(e.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
        to = self.triples.join(e.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
        return {"current": temporal.current(of), "incoming": temporal.current(to), "history": of.orderBy("created_at", "id")}

    def cleanup(self, action: str, name: str | None = None, into: str | None = None, triple_id: str | None = None) -> DataFrame | dict[str, int]:
        """list_entities, list_triples, delete_entity, delete_triple, merge_entities, find_duplicates, find_orphans, purge_orphans, purge_expired."""
        e, t = self.entities, self.triples
        named = lambda n: e.where(F.lower(F.trim("name")) == (n or "").strip().lower()).select("id")
        if action == "list_entities":
            return graph.degrees(e, t)
        if action == "list_triples":
            return self.facts()
        if action == "find_duplicates":
            return graph.prefix_duplicates(e)
        if action == "find_orphans":
            return graph.orphans(e, t)
        if action == "purge_orphans":
            return self.store.publish(entities=graph.touched(e, t))
        if action == "purge_expired":
            return self.store.publish(triples=temporal.current(t))
        if action == "delete_triple":
            return self.store.publish(triples=t.where(F.col("id") != triple_id))
        if action == "delete_entity":
            e2, t2 = graph.delete_entities(e, t, named(name))
            return self.store.publish(entities=e2, triples=t2)
        if action == "merge_entities":
            keep = named(into).agg(F.min("id").alias("keep"))
            e2, t2 = graph.merge_entities(e, t, named(name).crossJoin(F.broadcast(keep)).where("keep is not null"))
            return self.store.publish(entities=e2.select(e.columns), triples=t2)
        raise ValueError(f"unknown action {action}")

    def consolidate(self, now: float, below: float = 0.05, half_life_days: float = 30.0) -> dict[str, int]:
        e, t = consolidation.consolidate(self.entities, self.triples, now, below, half_life_days)
        return self.store.publish(entities=e.select(self.entities.columns), triples=t.select(self.triples.columns))

    def clusters(self) -> DataFrame:
        return spectral.clusters(spectral.adjacency(self.triples))

    def compress(self, budget: int) -> DataFrame:
        return compression.compress(self.entities, self.triples, budget)

    def stats(self) -> DataFrame:
        return consolidation.graph_stats(self.entities, self.triples)

    def usage(self) -> DataFrame:
        return store.usage(self.messages, self.entities, self.triples).withColumn("stored_bytes", F.lit(self.store.size()))

    def check(self) -> DataFrame:
        return store.integrity(self.entities, self.triples)

    def retain(self, path: str, before: float | None = None, keep_latest: int | None = None, apply: bool = False) -> DataFrame:
        """Messages due for the archive; with ``apply`` they are written to ``path`` and taken out of the store. Facts stay."""
        due = archive.retention(self.messages, before, keep_latest)
        if apply:
            archive.write_archive(due, path)
            back = archive.read_archive(self.spark, path)
            self.store.publish(messages=self.messages.join(back.where("ok").select("id"), "id", "left_anti").select(self.messages.columns))
            return back
        return due

    def restore(self, path: str) -> dict[str, int]:
        """Brings back archived messages that the store lacks. An archive with a damaged line is refused as a whole."""
        bad = archive.read_archive(self.spark, path).where("not ok").select("error").limit(1).collect()
        if bad:
            raise ValueError(f"the archive is damaged: {bad[0].error}")
        return self.store.publish(messages=archive.restore(self.messages, archive.read_archive(self.spark, path)))
