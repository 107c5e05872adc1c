"""Queries on periods, references and histories of facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.functions.keys import end_or_open, norm_id, norm_predicate, object_key, show_end, valid_period
from sediment.operators.history import HistoryStore
from sediment.operators.intervals import merge_periods, periods_and_gaps
from sediment.operators.references import find_broken
from sediment.session import scratch, small_side
from sediment.sources.tables import table

KEYS = ["subject_id", "predicate"]


def _merged(spark: SparkSession, d: str, hot_rows: int = 500_000) -> DataFrame:
    t = table(spark, d, "triples").where(valid_period(F.col("valid_from"), F.col("valid_until")))
    t = t.select(
        norm_id(F.col("subject_id")).alias("subject_id"),
        norm_predicate(F.col("predicate")).alias("predicate"),
        F.col("valid_from").cast("bigint").alias("s"),
        end_or_open(F.col("valid_until")).alias("e"),
        F.xxhash64(norm_id(F.col("id"))).alias("h"),
    )
    # records with one start share time, unless they are the same record stored again
    t = t.groupBy(*KEYS, "s").agg(F.max("e").alias("e"), (F.min("h") != F.max("h")).alias("shared"))
    return merge_periods(t, KEYS, hot_rows=hot_rows)


def p3_found(spark: SparkSession, d: str, hot_rows: int = 500_000) -> DataFrame:
    out = periods_and_gaps(_merged(spark, d, hot_rows), KEYS).where("kind = 'gap' or shared")
    return out.select(*KEYS, "kind", "from_s", show_end(F.col("until_s")).alias("until_s"))


def p3_sharded(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, but every key of more than twenty records goes the way of huge ones: cut into time shards, merged there, stitched."""
    return p3_found(spark, d, 20)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each predicate: merged periods, gaps, and seconds covered by closed periods and lost in gaps."""
    p = periods_and_gaps(_merged(spark, d), KEYS)
    closed = F.col("until_s") < 9223372036854775807
    length = F.col("until_s") - F.col("from_s")
    return p.groupBy("predicate").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.count_if(F.col("kind") == "gap").alias("n_gaps"),
        F.coalesce(F.sum(F.when((F.col("kind") == "period") & closed, length)), F.lit(0)).alias("covered_s"),
        F.coalesce(F.sum(F.when(F.col("kind") == "gap", length)), F.lit(0)).alias("gap_s"),
    )


def _broken(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples")
    one = lambda name, kind: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), norm_id(F.col(name)).alias("key"))
    refs = t.select(
        norm_id(F.col("id")).alias("rec_id"), "created_at", F.explode(F.array(one("source_ref", "c"), one("subject_id", "e"), one("object_id", "e"))).alias("r")
    ).select("rec_id", "created_at", "r.*")
    held = lambda name, kind, at: table(spark, d, name).select(F.lit(kind).alias("kind"), norm_id(F.col("id")).alias("key"), F.col(at).alias("at"), F.lit(False).alias("named"))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.col("details"), F.lit('"([^"]+)"'), F.lit(1))))
    gone = table(spark, d, "consolidation_log").select(words.alias("key")).select(norm_id(F.col("key")).alias("key")).distinct()
    gone = gone.select(F.explode(F.array(F.lit("c"), F.lit("e"))).alias("kind"), "key", F.lit(None).cast("double").alias("at"), F.lit(True).alias("named"))
    # some sessions store their times in milliseconds
    seconds = F.when(F.col("at") > MILLIS_FROM, F.col("at") / 1000).otherwise(F.col("at"))
    parents = held("entities", "e", "created_at").unionByName(held("conversations", "c", "timestamp").withColumn("at", seconds)).unionByName(gone)
    return find_broken(refs, parents)


#: Fixed value: Unix times above are milliseconds (as seconds they would lie in the year 5138).
MILLIS_FROM = 1e11


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # a record stored again gives the same rows; only broken ones are left here
    return (
        _broken(spark, d)
        .select(F.col("rec_id").alias("triple_id"), F.col("field").alias("ref_field"), "ref_status", F.when(F.abs("created_at") < 1e11, F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM")).alias("period"))
        .distinct()
    )


def p5_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table that should hold the target, field, state and month."""
    target = F.when(F.col("ref_field") == "source_ref", "conversations").otherwise("entities")
    return p5_found(spark, d).groupBy(target.alias("target_table"), "ref_field", "ref_status", "period").agg(F.count("*").alias("n_refs"))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """Records of stateful attributes, and the start of the last month in which any was made."""
    t = table(spark, d, "triples")
    last = t.where(F.abs("created_at") < 1e11).agg(F.date_trunc("month", F.timestamp_seconds(F.max("created_at"))).cast("double").alias("m")).first()
    kinds = table(spark, d, "predicate_kinds").where("kind = 'stateful'").select(norm_predicate(F.col("predicate")).alias("predicate")).distinct()
    records = (
        t.where((F.col("relation_type") == "fact") & valid_period(F.col("valid_from"), F.col("valid_until")))
        .select(
            norm_id(F.col("subject_id")).alias("subject_id"),
            norm_predicate(F.col("predicate")).alias("predicate"),
            F.col("created_at").alias("created"),
            F.col("valid_from").cast("bigint").alias("s"),
            end_or_open(F.col("valid_until")).alias("e"),
            F.xxhash64(object_key(F.col("object_id"), F.col("object_value"))).alias("tag"),
        )
        .join(small_side(kinds), "predicate", "left_semi")
    )
    return records, last.m or 0.0


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The history kept from two snapshots: of what was recorded before the last month, and of all."""
    records, month = _records(spark, d)
    kept = HistoryStore(spark, scratch(spark, "history"), KEYS)
    kept.update(records.where(F.col("created") < month))
    kept.update(records)
    h = kept.read().withColumn("n", F.count("*").over(Window.partitionBy(*KEYS))).where("n > 1")
    return h.select(*KEYS, F.col("s").alias("from_s"), show_end(F.col("e")).alias("until_s"))


QUERIES = {f.__name__: f for f in (p3_found, p3_sharded, p3_coverage, p5_found, p5_by_period, p6_found)}

_T = """t AS (
  SELECT DISTINCT lower(trim(id)) AS id, lower(trim(subject_id)) AS subject_id, translate(lower(trim(predicate)), ' -', '__') AS predicate,
         CAST(valid_from AS BIGINT) AS s, coalesce(CAST(valid_until AS BIGINT), 9223372036854775807) AS e, relation_type, created_at,
         CASE WHEN object_id IS NOT NULL THEN 'i:' || lower(trim(object_id)) ELSE 'v:' || lower(trim(object_value)) END AS tag
  FROM triples WHERE valid_from IS NOT NULL AND (valid_until IS NULL OR valid_until > valid_from))"""

_P3 = f"""WITH {_T},
 r AS (SELECT *, max(e) OVER (PARTITION BY subject_id, predicate ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM r),
 m AS (SELECT subject_id, predicate, min(s) AS s, max(e) AS e, bool_or(coalesce(s < reach, false)) AS shared FROM i GROUP BY subject_id, predicate, g),
 n AS (SELECT *, lead(s) OVER (PARTITION BY subject_id, predicate ORDER BY s) AS next_s FROM m)"""

_P5 = """WITH r AS (
  SELECT lower(trim(id)) AS id, created_at, 'source_ref' AS f, lower(trim(source_ref)) AS k FROM triples UNION
  SELECT lower(trim(id)), created_at, 'subject_id', lower(trim(subject_id)) FROM triples UNION
  SELECT lower(trim(id)), created_at, 'object_id', lower(trim(object_id)) FROM triples),
 p AS (SELECT 'source_ref' AS f, lower(trim(id)) AS k, min(CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END) AS at FROM conversations GROUP BY 2
   UNION ALL SELECT 'entity', lower(trim(id)), min(created_at) FROM entities GROUP BY 2),
 g AS (SELECT DISTINCT lower(trim(unnest(regexp_extract_all(details, '"([^"]+)"', 1)))) AS k FROM consolidation_log),
 b AS (SELECT DISTINCT r.id AS triple_id, r.f AS ref_field,
   CASE WHEN p.k IS NULL THEN CASE WHEN g.k IS NULL THEN 'missing' ELSE 'deleted' END WHEN p.at > r.created_at THEN 'late' END AS ref_status,
   strftime(make_timestamp(CAST(floor(r.created_at) AS BIGINT) * 1000000), '%Y-%m') AS period
   FROM r LEFT JOIN p ON p.k = r.k AND p.f = CASE WHEN r.f = 'source_ref' THEN r.f ELSE 'entity' END LEFT JOIN g ON g.k = r.k
   WHERE r.k IS NOT NULL AND r.k <> '')"""

SQL = {
    "p3_found": f"""{_P3}
 SELECT subject_id, predicate, 'period' AS kind, s AS from_s, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS until_s FROM n WHERE shared
 UNION ALL SELECT subject_id, predicate, 'gap', e, next_s FROM n WHERE next_s IS NOT NULL""",
    "p3_coverage": f"""{_P3}
 SELECT predicate, count(*) AS n_periods, count(next_s) AS n_gaps,
   CAST(coalesce(sum(CASE WHEN e < 9223372036854775807 THEN e - s END), 0) AS BIGINT) AS covered_s, CAST(coalesce(sum(next_s - e), 0) AS BIGINT) AS gap_s
 FROM n GROUP BY predicate""",
    "p5_found": f"{_P5} SELECT * FROM b WHERE ref_status IS NOT NULL",
    "p5_by_period": f"""{_P5} SELECT CASE WHEN ref_field = 'source_ref' THEN 'conversations' ELSE 'entities' END AS target_table, ref_field, ref_status, period,
 count(*) AS n_refs FROM b WHERE ref_status IS NOT NULL GROUP BY ALL""",
    "p6_found": f"""WITH {_T},
 k AS (SELECT DISTINCT translate(lower(trim(predicate)), ' -', '__') AS predicate FROM predicate_kinds WHERE kind = 'stateful'),
 h AS (SELECT subject_id, predicate, s, e, tag FROM t SEMI JOIN k USING (predicate) WHERE relation_type = 'fact'
   QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, s ORDER BY created_at DESC NULLS LAST, e DESC) = 1),
 c AS (SELECT subject_id, predicate, s, least(e, coalesce(lead(s) OVER (PARTITION BY subject_id, predicate ORDER BY s), e)) AS e, tag FROM h),
 f AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(tag) OVER w = tag THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY s)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY subject_id, predicate ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM f),
 v AS (SELECT subject_id, predicate, min(s) AS s, max(e) AS e FROM i GROUP BY subject_id, predicate, g)
 SELECT subject_id, predicate, s AS from_s, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS until_s FROM v
 QUALIFY count(*) OVER (PARTITION BY subject_id, predicate) > 1""",
}

SQL["p3_sharded"] = SQL["p3_found"]
