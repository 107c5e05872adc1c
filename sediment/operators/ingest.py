"""From messages to the graph: extraction, resolution of names, assertions. Whole batches at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.text import facts, proper_names, quoted

#: Predicates that hold several values at a time.
ADDITIVE = ("caused", "contains", "depends", "depends_on", "includes", "implements", "knows", "likes", "member_of", "related_to", "requires", "supports", "uses", "works_on", "works_with")


def extract(messages: DataFrame) -> DataFrame:
    """``id``, ``timestamp``, ``names`` (capitalised runs and quoted texts, first occurrences in order) and ``facts`` (structs subject, predicate, object)."""
    return messages.select("id", "timestamp", F.array_distinct(F.concat(proper_names(F.col("content")), quoted(F.col("content")))).alias("names"), facts(F.col("content")).alias("facts"))


def extract_with(messages: DataFrame, predict: Callable[[list[str]], list[str]]) -> DataFrame:
    """As extract, by a model that answers each text with JSON of ``entities`` and ``facts``. Fences around the JSON are removed; what can't be read gives nothing."""
    schema = "struct<entities: array<string>, facts: array<struct<subject: string, predicate: string, object: string>>>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["id", "timestamp"]].assign(answer=predict(list(pdf["content"].fillna(""))))

    answers = messages.select("id", "timestamp", "content").mapInPandas(run, "id string, timestamp double, answer string")
    j = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), schema)
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string>>")
    return answers.withColumn("_j", j).select("id", "timestamp", F.coalesce("_j.entities", F.array().cast("array<string>")).alias("names"), F.coalesce("_j.facts", none).alias("facts"))


def resolve(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """``mentions``: ``name``, ``entity_type``?, ``at``. Merged with ``known`` (``id``, ``name``, ``entity_type``, ``created_at``): one entity for each name, case and outer blanks aside.

    New ones get an id from their name; a missing type is filled by the earliest mention that has one, never overwritten. Blank names are left out.
    """
    key = F.lower(F.trim("name"))
    m = mentions.withColumn("name_key", key).where("name_key <> ''").groupBy("name_key").agg(
        F.min_by(F.trim("name"), "at").alias("m_name"), F.min("at").alias("m_at"), F.min(F.when(F.col("entity_type").isNotNull(), F.struct("at", "entity_type"))).alias("m_type")
    )
    k = known.withColumn("name_key", key).where("name_key <> ''").groupBy("name_key").agg(F.min(F.struct("created_at", "id", "name", "entity_type")).alias("k"))
    j = k.join(m, "name_key", "full")
    return j.select(
        F.coalesce("k.id", F.sha2("name_key", 256)).alias("id"),
        F.coalesce("k.name", "m_name").alias("name"),
        F.coalesce("k.entity_type", "m_type.entity_type").alias("entity_type"),
        F.coalesce("k.created_at", "m_at").alias("created_at"),
        "name_key",
        F.col("k").isNull().alias("is_new"),
    )


def assertions(extracted: DataFrame) -> DataFrame:
    """Facts of messages as assertions in order of arrival: ``subject_key``, ``predicate``, ``object_key``, ``links`` (the object is a name known by then in the message), ``valid_from``, ``replaces``, ``source_ref``, ``seq``."""
    f = extracted.select("id", "timestamp", "names", "facts", F.posexplode("facts").alias("pos", "f"))
    o = F.lower(F.trim("f.object"))
    names = F.transform("names", lambda x: F.lower(F.trim(x)))
    earlier = F.transform(F.slice("facts", 1, F.col("pos")), lambda x: F.lower(F.trim(x["subject"])))
    w = Window.partitionBy(F.lower(F.trim("f.subject")), "f.predicate").orderBy("timestamp", "id", "pos")
    return f.select(
        F.lower(F.trim("f.subject")).alias("subject_key"),
        F.col("f.predicate").alias("predicate"),
        o.alias("object_key"),
        (F.array_contains(names, o) | F.array_contains(earlier, o)).alias("links"),
        F.col("timestamp").alias("valid_from"),
        (~F.lower("f.predicate").isin(*ADDITIVE)).alias("replaces"),
        F.col("id").alias("source_ref"),
        F.row_number().over(w).alias("seq"),
    ).where("subject_key <> '' and object_key <> ''")
