"""The tables as the engine sees them: each id once, ids and predicates in their normal form; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.keys import norm_id, norm_predicate
from sediment.functions.text import tokens
from sediment.functions.vectors import hashed
from sediment.sources.tables import table

#: Parameters of the queries: the present, a moment for as-of reads, and texts to search for.
NOW, AT = 1_750_000_000.0, 1_720_000_000.0
ASKED = (
    (1, "which tariff model still needs the rollback steps"),
    (2, "the permit was cancelled before the claimant delivered the warranty"),
    (3, "ledger import wrong currency after the holiday"),
    (4, "Court of Appeal Ostermere burden of mitigation"),
    (5, "Norwick Bay office confirmed order"),
)


COMPARED = (*ASKED[:3], (6, "Compare Norwick Bay and Greyfen on the tariff model"))


def embedding(text: Column) -> Column:
    """Of a text, as no model is at hand."""
    return hashed(tokens(F.coalesce(text, F.lit(""))))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid int, text string")


def _latest(df: DataFrame) -> DataFrame:
    """Each id once. A row stored again differs at most in its accesses: those of the most-accessed row stand, then of the latest. One aggregate for each column, so that unused ones are never read."""
    latest = F.max(F.struct("access_count", "last_accessed"))
    kept = {"access_count": latest["access_count"], "last_accessed": latest["last_accessed"]}
    return df.groupBy("id").agg(*(kept.get(c, F.max(c)).alias(c) for c in df.columns if c != "id"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return _latest(table(spark, d, "entities").withColumn("id", norm_id(F.col("id"))))


def triples(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """``where``: a condition on columns that a row stored again doesn't change; it goes to the scan."""
    t = table(spark, d, "triples").where(where)
    ref = F.when(F.trim("source_ref") != "", norm_id(F.col("source_ref")))
    t = t.withColumns({"id": norm_id(F.col("id")), "subject_id": norm_id(F.col("subject_id")), "object_id": norm_id(F.col("object_id")), "predicate": norm_predicate(F.col("predicate")), "source_ref": ref})
    return _latest(t)


def messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    at = F.when(F.col("timestamp") > 1e11, F.col("timestamp") / 1000).otherwise(F.col("timestamp"))
    m = m.withColumns({"id": norm_id(F.col("id")), "timestamp": at, "role": F.lower(F.trim("role")), "session_id": F.when(F.trim("session_id") != "", norm_id(F.col("session_id")))})
    return m.dropDuplicates(["id"])


_PICK = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY access_count DESC NULLS LAST, last_accessed DESC NULLS LAST) = 1"
E = f"e AS (SELECT lower(trim(id)) AS id, name, entity_type, created_at, confidence, access_count, last_accessed, embedding FROM entities {_PICK})"
T = f"""t AS (SELECT lower(trim(id)) AS id, lower(trim(subject_id)) AS subject_id, translate(lower(trim(predicate)), ' -', '__') AS predicate, lower(trim(object_id)) AS object_id,
 object_value, relation_type, confidence, valid_from, valid_until, CASE WHEN trim(source_ref) <> '' THEN lower(trim(source_ref)) END AS source_ref, created_at, last_accessed, access_count FROM triples {_PICK})"""
M = """m AS (SELECT lower(trim(id)) AS id, CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS ts, lower(trim(role)) AS role, content,
 CASE WHEN trim(session_id) <> '' THEN lower(trim(session_id)) END AS session_id, metadata FROM conversations QUALIFY row_number() OVER (PARTITION BY lower(trim(id))) = 1)"""
Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ") AS v(qid, text))"
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
HASHED = "list_transform([list_transform({}, lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % 64)], lambda a: list_transform(range(64), lambda i: len(list_filter(a, lambda b: b = i))::DOUBLE))[1]"
