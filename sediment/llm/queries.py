"""Queries of the text and algorithm operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import leakage, mixing, names, neighbours, paragraphs, pii, sessions, spans
from sediment.sources.tables import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, column: spread(table(spark, d, name).select(F.lit(name).alias("tbl"), F.lower(F.trim("id")).alias("rec_id"), F.col(column).alias("text")))
    return one("conversations", "content").unionByName(one("triples", "object_value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # a record stored again gives the same rows
    return pii.find_pii(_texts(spark, d), table(spark, d, "short_names")).drop("end_pos").distinct()


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """All messages and literal facts with typed placeholders."""
    return pii.mask_pii(_texts(spark, d), table(spark, d, "short_names"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, column: table(spark, d, name).select(F.lit(name).alias("tbl"), F.lower(F.trim("id")).alias("id"), F.col(column).alias("vec"))
    return one("entities", "embedding").unionByName(one("clusters", "centroid"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "vector_probes").select(F.col("vec_table").alias("tbl"), F.lower(F.trim("vec_id")).alias("id"))
    return neighbours.nearest(_vectors(spark, d), probes).select(F.col("tbl").alias("vec_table"), F.col("id").alias("vec_id"), "neighbour_id")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every usable vector."""
    return neighbours.nearest(_vectors(spark, d), None).select(F.col("tbl").alias("vec_table"), F.col("id").alias("vec_id"), "neighbour_id", F.round("sim", 4).alias("sim"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_defects(table(spark, d, "conversations")).withColumnRenamed("sid", "session_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The messages of sound sessions in order, at their corrected times."""
    c = sessions.conversations(table(spark, d, "conversations"))
    return c.select(F.col("sid").alias("session_id"), "pos", "role", F.round("at", 3).alias("at"), "id", "content")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select(F.lower(F.trim("id")).alias("id"), "name", "entity_type")
    return names.link_names(e, table(spark, d, "short_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(_groups(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each id with the smallest id that means the same."""
    g = _groups(spark, d)
    return g.join(g.groupBy("grp").agg(F.min("id").alias("group_id"), F.count("*").alias("n_ids")), "grp").select("id", "group_id", "n_ids")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_docs(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many documents, and the largest share of the item in one."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("id").alias("n_docs"), F.round(F.max("share"), 6).alias("max_share"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All rulings without the passages of held-out items; those that consist of them by more than half are gone."""
    kept = leakage.remove_leaks(_docs(spark, d), table(spark, d, "eval_items"))
    return kept.select(F.col("id").alias("doc_id"), F.length("text").alias("n_chars"), "removed_chars", F.md5("text").alias("text_md5"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers as P

    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text"))
    return mixing.count_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from sediment.session import cut

    return mixing.mix(cut(_sized(spark, d)), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_docs(spark, d), only_found=True).select(F.col("id").alias("doc_id")).distinct()


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each ruling with shared spans: how many there are, their characters, and the share of the text that they cover."""
    docs = _docs(spark, d)
    found = spans.coverage(spans.shared_spans(docs)).groupBy("id").agg(F.count("*").alias("n_spans"), F.sum(F.col("to_pos") - F.col("from_pos")).alias("shared_chars"))
    size = docs.select("id", F.length("text").alias("n_chars"))
    return found.join(size, "id").select(F.col("id").alias("doc_id"), "n_spans", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))


def p10_removals(spark: SparkSession, d: str) -> DataFrame:
    """Of every paragraph of the rulings that is as long as a span its class of near-duplicates, and whether it stays."""
    c = paragraphs.paragraph_classes(_docs(spark, d), min_chars=200)
    return c.select(F.col("id").alias("doc_id"), "no", F.col("first_id").alias("class_doc_id"), F.col("first_no").alias("class_no"), "n_links", "stays")


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_neighbours, p4_found, p4_conversations, p7_found, p7_groups, p8_found, p8_items, p8_cleaned, p9_mix, p9_shares, p10_found, p10_coverage, p10_removals)}

_ROLE = "CASE lower(trim(role)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'unknown' END"

SQL = {
    "p4_found": f"""WITH m AS (
  SELECT lower(trim(session_id)) AS session_id, coalesce({_ROLE}, 'unknown') AS role, CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS tm,
    TRY_CAST(json_extract_string(metadata, '$.turn') AS INTEGER) AS turn, coalesce(regexp_matches(content, '[^\\s\\pZ]'), false) AS txt FROM conversations
  WHERE session_id IS NOT NULL AND trim(session_id) <> ''),
 s AS (SELECT session_id, max(turn) AS top, count(DISTINCT turn) AS n, bool_or(role = 'unknown') AS bad FROM m GROUP BY 1),
 u AS (SELECT session_id, role, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn, 2147483647), tm, role DESC) AS i,
   row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn, 2147483647) DESC, tm DESC, role) AS j FROM m WHERE txt AND role IN ('user', 'assistant'))
 SELECT session_id, 'empty' AS defect FROM s ANTI JOIN u USING (session_id)
 UNION ALL SELECT session_id, 'no_opening' FROM u WHERE i = 1 AND role = 'assistant'
 UNION ALL SELECT session_id, 'no_reply' FROM u WHERE j = 1 AND role = 'user'
 UNION ALL SELECT session_id, 'lost_turn' FROM s WHERE n < top + 1
 UNION ALL SELECT session_id, 'bad_role' FROM s WHERE bad""",
}

_WINDOWS = """w AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
 b AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), x AS (SELECT doc_id, i FROM w SEMI JOIN b USING (h))"""
_TEXT = "coalesce(regexp_matches(content, '[^\\s\\pZ]'), false)"
SQL["p4_conversations"] = f"""WITH m AS (
  SELECT DISTINCT ON (lower(trim(session_id)), lower(trim(id))) lower(trim(session_id)) AS sid, lower(trim(id)) AS id, coalesce({_ROLE}, 'unknown') AS role,
    CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS tm, TRY_CAST(json_extract_string(metadata, '$.turn') AS INTEGER) AS turn, content, {_TEXT} AS txt
  FROM conversations WHERE session_id IS NOT NULL AND trim(session_id) <> ''),
 t AS (SELECT sid, turn, arg_min(role = 'user', tm) AS u, min(tm) AS tm FROM m WHERE turn IS NOT NULL AND role <> 'unknown' GROUP BY ALL),
 st AS (SELECT a.sid, CASE WHEN a.u THEN a.tm - b.tm END AS lo, CASE WHEN b.u THEN b.tm - a.tm END AS hi FROM t a JOIN t b ON a.sid = b.sid AND b.turn = a.turn + 1 AND a.u <> b.u),
 f AS (SELECT sid, max(lo) AS lo, min(hi) AS hi, avg(coalesce(lo, hi)) AS mean FROM st GROUP BY sid),
 o AS (SELECT sid, coalesce(lo <= hi, true) AS feasible, CASE WHEN coalesce(lo <= 0, true) AND coalesce(hi >= 0, true) THEN 0.0 ELSE greatest(least(mean, hi), lo) END AS shift FROM f),
 c AS (SELECT m.*, coalesce(feasible, true) AS feasible, tm + CASE WHEN role = 'user' THEN 0.0 ELSE coalesce(shift, 0.0) END AS tc FROM m LEFT JOIN o USING (sid)),
 g AS (SELECT *, coalesce(tc - lag(tc) OVER (PARTITION BY sid, role, content ORDER BY tc, id) <= 5, false) AS again, CASE WHEN turn IS NULL THEN tc ELSE max(tc) OVER (PARTITION BY sid, turn IS NULL ORDER BY turn, tc ROWS UNBOUNDED PRECEDING) END AS reach FROM c),
 k AS (SELECT *, NOT again AND ((txt AND role IN ('user', 'assistant')) OR (role = 'system' AND content IS NOT NULL)) AS kept FROM g),
 n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY reach, coalesce(turn, 2147483647), tc, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 3 END, id) - 1 AS pos FROM k WHERE kept),
 x AS (SELECT sid, arg_min(role, pos) AS a, arg_max(role, pos) AS z FROM n WHERE role <> 'system' GROUP BY sid),
 s AS (SELECT sid FROM c GROUP BY sid HAVING bool_and(feasible) AND bool_and(role <> 'unknown') AND coalesce(count(DISTINCT turn) = max(turn) + 1, true))
 SELECT sid AS session_id, pos, role, round(tc, 3) AS at, id, content FROM n SEMI JOIN s USING (sid) SEMI JOIN (SELECT sid FROM x WHERE a = 'user' AND z = 'assistant') y USING (sid)"""
SQL["p10_found"] = f"WITH {_WINDOWS} SELECT DISTINCT doc_id FROM x"
SQL["p10_coverage"] = f"""WITH {_WINDOWS}, f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM x),
 g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM f), c AS (SELECT doc_id, max(i) - min(i) + 200 AS n FROM g GROUP BY doc_id, g),
 a AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS shared_chars FROM c GROUP BY doc_id)
 SELECT doc_id, n_spans, shared_chars, round(shared_chars / length(text), 6) AS shared_share FROM a JOIN documents USING (doc_id)"""
_VECTORS = "SELECT 'entities' AS t, lower(trim(id)) AS id, embedding::DOUBLE[] AS v FROM entities UNION SELECT 'clusters', lower(trim(id)), centroid::DOUBLE[] FROM clusters"
SQL["p2_found"] = f"""WITH v AS (SELECT * FROM ({_VECTORS}) WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
 p AS (SELECT DISTINCT vec_table AS t, lower(trim(vec_id)) AS id FROM vector_probes)
 SELECT a.t AS vec_table, a.id AS vec_id, b.id AS neighbour_id FROM v a SEMI JOIN p ON p.t = a.t AND p.id = a.id JOIN v b ON a.t = b.t AND a.id <> b.id
 QUALIFY row_number() OVER (PARTITION BY a.t, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) <= 10"""
