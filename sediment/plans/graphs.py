"""Queries on the graph, temporal reads, vectors, fusion, spectra, consolidation and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.functions.keys import object_key
from sediment.functions.text import render_fact
from sediment.operators import compression, consolidation, dense, evaluation, graph, retrieval, search, spectral, temporal
from sediment.operators.lexical import Matched, bm25, top_k
from sediment.plans.base import AT, COMPARED, HASHED, NOW, E, M, Q, T, TOKENS, asked, embedding, entities, messages, triples
from sediment.sources.tables import spread, table


def find_entities(spark: SparkSession, d: str) -> DataFrame:
    e = search.find_entities(entities(spark, d), "Project ")
    return e.select("id", "name")


def delete_entity(spark: SparkSession, d: str) -> DataFrame:
    """Triples of each relation left when all organisations are deleted."""
    e, t = entities(spark, d), triples(spark, d)
    return graph.delete_entities(e, t, e.where("entity_type = 'organisation'"))[1].groupBy("relation_type").agg(F.count("*").alias("n"))


def touch_access(spark: SparkSession, d: str) -> DataFrame:
    """Access counts of entities after all open causal and dependency facts were read once."""
    t = triples(spark, d)
    e, _ = graph.touch(entities(spark, d), t, t.where("valid_until is null and relation_type in ('causal', 'depends')"), NOW)
    return e.select("id", "access_count", (F.col("last_accessed") == NOW).alias("read_now"))


def local_subgraph_gap(spark: SparkSession, d: str) -> DataFrame:
    """Gap and radius around the entities of the first cluster by id."""
    c = table(spark, d, "clusters").where("entity_ids <> '[]'").groupBy().agg(F.min(F.struct("id", "entity_ids")).alias("c"))
    gap, radius = spectral.local_gap(triples(spark, d), c.select(F.explode(F.from_json("c.entity_ids", "array<string>")).alias("id")), 3)
    return spark.range(1).select(F.lit(gap).alias("gap"), F.lit(radius).alias("radius"))


def multi_probe_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = dense.multi_probe(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10, 64)
    return r.select("qid", "id", F.round("score", 6).alias("score"), "pos")


def _value() -> object:
    return object_key(F.col("object_id"), F.col("object_value"))


def current_facts(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d, "valid_until is null").groupBy("predicate").agg(F.count("*").alias("n_open"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def as_of_facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.as_of(triples(spark, d, f"valid_from <= {AT}"), AT).select("id", "subject_id", "predicate")


def fact_history(spark: SparkSession, d: str) -> DataFrame:
    """All versions of each (subject, predicate) in order."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("valid_from", "created_at", "id")
    return triples(spark, d, "valid_from is not null").select("subject_id", "predicate", "id", F.row_number().over(w).alias("version"))


def scd2_facts(spark: SparkSession, d: str) -> DataFrame:
    """Open assertions of facts superseding each other in order of their starts."""
    t = triples(spark, d, "relation_type = 'fact' and valid_from is not null")
    seq = F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy("valid_from", "created_at", "id"))
    a = t.select("id", "subject_id", "predicate", _value().alias("value"), "valid_from", seq.alias("seq"), F.lit(True).alias("replaces"))
    return temporal.supersede(a, ["subject_id", "predicate"]).select("id", "valid_from", "valid_until")


def late_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts in order of arrival: those rejected because they are older than what they would replace, per predicate."""
    t = triples(spark, d, "relation_type = 'fact' and valid_from is not null")
    seq = F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy("created_at", "id"))
    a = t.select("subject_id", "predicate", _value().alias("value"), "valid_from", seq.alias("seq"), F.lit(True).alias("replaces"))
    return temporal.supersede_any(a, ["subject_id", "predicate"]).groupBy("predicate").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.contradictions(triples(spark, d, "valid_until is null and relation_type = 'fact'"), _value())


def triple_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Open facts of one predicate and relation, the most confident first, then the latest."""
    t = triples(spark, d, "valid_until is null and relation_type = 'fact'").where("predicate = 'maintainer'")
    return t.select("id", F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("confidence"), F.desc("created_at"), "id")).alias("pos"))


def list_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(entities(spark, d), triples(spark, d)).select("id", "degree")


def list_triples(spark: SparkSession, d: str) -> DataFrame:
    """Open facts as text, with the names of both ends."""
    e, t = entities(spark, d).select("id", "name"), triples(spark, d, "valid_until is null")
    j = t.join(e.select(F.col("id").alias("subject_id"), F.col("name").alias("s")), "subject_id", "left").join(e.select(F.col("id").alias("object_id"), F.col("name").alias("o")), "object_id", "left")
    return j.select("id", F.md5(render_fact(F.col("s"), F.col("predicate"), F.col("object_value"), F.col("o"), F.col("object_id"))).alias("text_md5"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(entities(spark, d), triples(spark, d)).select("id")


def touched_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.touched(entities(spark, d), triples(spark, d, "relation_type = 'causal'")).select("id")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return graph.prefix_duplicates(entities(spark, d))


def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one name merged: triples of each subject afterwards."""
    e, t = entities(spark, d), triples(spark, d)
    return graph.merge_entities(e, t, graph.same_names(e))[1].groupBy("subject_id").agg(F.count("*").alias("n"))


def superseded_counts(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("subject_id").agg(F.count_if(F.col("valid_until").isNotNull()).alias("n_superseded"), F.sum("access_count").alias("n_accesses"))


def neighbours_3(spark: SparkSession, d: str) -> DataFrame:
    """Open triples within three steps of the entities of the first cluster by id, with their depth."""
    c = table(spark, d, "clusters").where("entity_ids <> '[]'").groupBy().agg(F.min(F.struct("id", "entity_ids")).alias("c"))
    start = c.select(F.explode(F.from_json("c.entity_ids", "array<string>")).alias("id"))
    return graph.neighbourhood(triples(spark, d, "valid_until is null"), start, 3)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return dense.exact_top_k(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, 10, 64)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the vectors whose id is divisible by 100."""
    return _dense(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "pos")


def dense_expansion_flag(spark: SparkSession, d: str) -> DataFrame:
    return dense.needs_expansion(_dense(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = _dense(spark, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ranked"))
    v = _vectors(spark, d)
    of = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label").join(v.select("label", "vec_id"), "label").where("vec_id <> qid")
    return r.join(of.groupBy("qid", "label").agg(F.collect_set("vec_id").alias("gold")), "qid")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the dense answers, the gold being all vectors of the query's label."""
    b = evaluation.bundle(_runs(spark, d)).withColumn("ndcg_retrieved_10", evaluation.ndcg_retrieved(F.col("ranked"), F.col("gold"), 10))
    names = [c for c in b.columns if c.startswith(("recall", "ndcg"))]
    return b.select("qid", *(F.round(c, 6).alias(c) for c in names))


def metric_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean measures by label and over all (label -1)."""
    b = evaluation.bundle(_runs(spark, d), (10,))
    r = b.rollup("label").agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("recall_any_10"), 6).alias("recall_any_10"), F.count("*").alias("n"))
    return r.fillna(-1, ["label"])


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two lexical runs over the documents, score by score."""
    matched = Matched(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")), asked(spark))
    a, b = (top_k(matched.score(v).withColumn("score", F.round("score", 9)), 20) for v in ("okapi", "plus"))
    c = evaluation.compare(a, b, ["qid", "id"], "score")
    return c.select("qid", "id", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"), F.round("delta", 6).alias("delta"), "state")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    e, t = entities(spark, d).select("id", "name"), triples(spark, d, "valid_until is null")
    j = t.join(e.select(F.col("id").alias("subject_id"), F.col("name").alias("s")), "subject_id", "left").join(e.select(F.col("id").alias("object_id"), F.col("name").alias("o")), "object_id", "left")
    return j.select("id", render_fact(F.col("s"), F.col("predicate"), F.col("object_value"), F.col("o"), F.col("object_id")).alias("text"), "confidence", "created_at", "access_count")


def recall_facts(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.recall_facts(_facts(spark, d), asked(spark), NOW)
    return r.select("qid", "id", F.round("score", 6).alias("score"), "pos")


def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Facts for queries that name entities: graph walk, BM25, reranking, decay."""
    e, t = entities(spark, d), triples(spark, d)
    first = e.where("entity_type = 'person'").groupBy().agg(F.min("name").alias("a"), F.max("name").alias("b"))
    q = first.select(F.lit(1).alias("qid"), F.concat(F.lit("which tools does "), F.col("a"), F.lit(" use")).alias("text")).union(first.select(F.lit(2), F.concat(F.lit("who manages "), F.col("b"))))
    return retrieval.recall(e, t, _facts(spark, d), q, NOW).select("qid", "id", F.round("score", 6).alias("score"), "pos")


def query_facets(spark: SparkSession, d: str) -> DataFrame:
    """Of each entity name a question that compares it with the greatest one, and one that doesn't, as facets."""
    e = entities(spark, d).where("name is not null")
    most = e.agg(F.max("name").alias("_m"))
    q = e.crossJoin(F.broadcast(most)).select("id", F.explode(F.array(F.concat(F.lit("How do "), "name", F.lit(" and "), "_m", F.lit(" each work?")), F.concat(F.lit("Who knows "), "name"))).alias("text"))
    return retrieval.query_facets(q.withColumnRenamed("id", "qid")).groupBy("facet").agg(F.count("*").alias("n"), F.count("entity").alias("n_named"))


def hybrid_stage1(spark: SparkSession, d: str) -> DataFrame:
    """The sixty nearest documents by hashed tokens fused with Okapi scores of all."""
    docs, q = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")), asked(spark)
    near = retrieval.dense_scores(docs.select("id", embedding(F.col("text")).alias("vec")), q.select("qid", embedding(F.col("text")).alias("vec")), 64, 60)
    f = retrieval.stage1(near, bm25(docs, q)).withColumn("score", F.round("score", 9))
    return top_k(f, 20).select("qid", "id", F.round("score", 6).alias("score"), "pos")


def retrieve_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by two asks of hashed tokens, BM25, and passages reranked by shared words."""
    docs = search.session_documents(messages(spark, d)).select(F.col("session_id").alias("id"), F.col("user_text").alias("text"), "all_text")
    return retrieval.retrieve_sessions(docs, asked(spark), embedding, 64).select("qid", "id", F.round("score", 6).alias("score"), "pos")


def grouped_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by their messages as windows: facets, dense and lexical ranks, names covered, reranked windows."""
    w = messages(spark, d).where("session_id is not null").select("id", F.col("session_id").alias("parent"), F.col("content").alias("text"))
    g = retrieval.retrieve_grouped(w, spark.createDataFrame(COMPARED, "qid int, text string"), embedding, 64)
    return g.select("qid", "parent", F.round("score", 6).alias("score"), "pos")


def temporal_score(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d)
    s = retrieval.decay(F.lit(NOW) - F.col("created_at"), F.col("access_count")) * F.col("confidence")
    return t.select("id", F.round(s, 6).alias("score"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null")).select("src", "dst", F.round("w", 6).alias("w"))


def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return spectral.weighted_degree(spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null"))).select("id", F.round("degree", 6).alias("degree"))


def laplacian_entries(spark: SparkSession, d: str) -> DataFrame:
    return spectral.laplacian(spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null"))).select("src", "dst", F.round("v", 6).alias("v"))


def decay_operator(spark: SparkSession, d: str) -> DataFrame:
    x = spectral.decay_operator(entities(spark, d), spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null")), NOW)
    return x.select("id", F.round("new_confidence", 6).alias("new_confidence"))


def spectral_gap(spark: SparkSession, d: str) -> DataFrame:
    gap = spectral.spectral_gap(spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null")))
    return spark.range(1).select(F.lit(gap).alias("gap"), spectral.radius(F.lit(gap)).alias("radius"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return spectral.clusters(spectral.adjacency(triples(spark, d, "valid_until is null and object_id is not null")))


def promote_repeated(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.promote_repeated(triples(spark, d)).select("id", F.round("confidence", 6).alias("confidence"))


def dedup_triples(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.dedup_triples(triples(spark, d)).select("id")


def self_references(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.drop_self_references(triples(spark, d)).groupBy("relation_type").agg(F.count("*").alias("n"))


def prune(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.prune(triples(spark, d), 0.3, NOW).groupBy("predicate").agg(F.count_if(F.col("valid_until") == NOW).alias("n_pruned"), F.count_if(F.col("valid_until").isNull()).alias("n_open"))


def decay_triples(spark: SparkSession, d: str) -> DataFrame:
    e, t = entities(spark, d), consolidation.drop_self_references(triples(spark, d))
    x = spectral.decay_operator(e, spectral.adjacency(t), NOW)
    return consolidation.apply_decay(e, t, x)[1].select("id", F.round("confidence", 6).alias("confidence"))


def consolidate(spark: SparkSession, d: str) -> DataFrame:
    e, t = consolidation.consolidate(entities(spark, d), triples(spark, d), NOW)
    return consolidation.graph_stats(e, t)


def cluster_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clusters").dropDuplicates(["id"])
    m = c.select(F.col("id").alias("cluster_id"), F.explode(F.array_distinct(F.from_json("entity_ids", "array<string>"))).alias("id"))
    x = consolidation.centroids(m, entities(spark, d).select("id", F.col("embedding").alias("vec")), 64)
    return x.select("cluster_id", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, b: a + b * b), 6).alias("squared_norm"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return consolidation.graph_stats(entities(spark, d), triples(spark, d))


def compress_l2(spark: SparkSession, d: str) -> DataFrame:
    return compression.compress(entities(spark, d), triples(spark, d), 2000)


def budget_report(spark: SparkSession, d: str) -> DataFrame:
    return compression.budget_report(entities(spark, d), triples(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        current_facts, as_of_facts, fact_history, scd2_facts, late_facts, contradictions, triple_pattern, list_entities, list_triples, orphans, touched_entities, duplicates, merge_entities,
        superseded_counts, neighbours_3, find_entities, delete_entity, touch_access, local_subgraph_gap, multi_probe_topk, dense_topk, dense_expansion_flag, retrieval_metrics, metric_by_label, compare_runs, recall_facts, recall_hybrid, query_facets, hybrid_stage1, retrieve_sessions, grouped_sessions, temporal_score,
        adjacency, weighted_degree, laplacian_entries, decay_operator, spectral_gap, clusters, promote_repeated, dedup_triples, self_references, prune, decay_triples, consolidate,
        cluster_centroid, graph_stats, compress_l2, budget_report,
    )
}

_TAG = "CASE WHEN object_id IS NOT NULL THEN 'i:' || object_id ELSE 'v:' || lower(trim(object_value)) END"
_ADJ = """w AS (SELECT subject_id AS s, object_id AS o, CASE relation_type WHEN 'causal' THEN 1.5 WHEN 'depends' THEN 1.2 WHEN 'supersedes' THEN 0.5 WHEN 'contradicts' THEN 0.3 ELSE 1.0 END * coalesce(confidence, 1.0) AS w
 FROM t WHERE object_id IS NOT NULL AND valid_until IS NULL),
 adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT s AS src, o AS dst, w FROM w UNION ALL SELECT o, s, w FROM w) GROUP BY ALL), deg AS (SELECT src AS id, sum(w) AS degree FROM adj GROUP BY src)"""
_TEXT = """trim(coalesce(s.name, '') || ' ' || replace(t.predicate, '_', ' ') || ' ' || coalesce(CASE WHEN object_value <> '' THEN object_value END, o.name, object_id, ''))"""
_NAMED = "t LEFT JOIN e s ON s.id = t.subject_id LEFT JOIN e o ON o.id = t.object_id WHERE t.valid_until IS NULL"
_DECAY = f"""sp AS (SELECT adj.src AS id, sum(adj.w * coalesce(e.confidence, 1.0)) / any_value(deg.degree) AS spread FROM adj JOIN e ON e.id = adj.dst JOIN deg ON deg.id = adj.src WHERE deg.degree > 0 GROUP BY adj.src),
 r0 AS (SELECT e.id, coalesce(e.confidence, 1.0) AS c, ln(1 + coalesce(access_count, 0)) AS acc, greatest({NOW} - created_at, 0.0) AS age, coalesce(spread, 0.0) AS spread FROM e LEFT JOIN sp USING (id)),
 r1 AS (SELECT id, c, 0.6 * spread + 0.2 * (CASE WHEN max(acc) OVER () > 0 THEN acc / max(acc) OVER () ELSE acc END) * c + 0.2 * exp(-ln(2.0) * age / 86400 / 30.0) * c AS raw FROM r0),
 dec AS (SELECT id, c, least(greatest(CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE raw END, 0.0), 1.0) AS n FROM r1)"""
_SIM = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 sc AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 top AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS pos FROM sc QUALIFY pos <= 10)"""
_METRIC = f"""{_SIM}, hit AS (SELECT top.qid, pos, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS h, a.label FROM top JOIN v a ON a.vec_id = top.qid JOIN v b ON b.vec_id = top.id),
 g AS (SELECT a.vec_id AS qid, count(*) AS gold FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1),
 idl AS (SELECT i AS n, sum(CASE WHEN i2 = 1 THEN 1.0 ELSE 1 / log2(i2) END) AS ideal, sum(1 / log2(i2 + 1)) AS ideal_h FROM range(1, 11) x(i), range(1, 11) y(i2) WHERE i2 <= i GROUP BY i),
 mt AS (SELECT qid, any_value(label) AS label, any_value(gold) AS gold, max(h) FILTER (pos <= 5) AS any5, max(h) AS any10, sum(h) FILTER (pos <= 5) AS n5, sum(h) AS n10,
  sum(h * CASE WHEN pos = 1 THEN 1.0 ELSE 1 / log2(pos) END) FILTER (pos <= 5) AS d5, sum(h * CASE WHEN pos = 1 THEN 1.0 ELSE 1 / log2(pos) END) AS d10, sum(h / log2(pos + 1)) AS dh FROM hit JOIN g USING (qid) GROUP BY qid),
 mm AS (SELECT qid, label, any5::DOUBLE AS recall_any_5, any10::DOUBLE AS recall_any_10, (n5 = gold)::INT::DOUBLE AS recall_all_5, (n10 = gold)::INT::DOUBLE AS recall_all_10,
  d5 / (SELECT ideal FROM idl WHERE n = least(gold, 5)) AS ndcg_5, d10 / (SELECT ideal FROM idl WHERE n = least(gold, 10)) AS ndcg_10,
  coalesce(dh / (SELECT ideal_h FROM idl WHERE n = n10), 0.0) AS ndcg_retrieved_10 FROM mt)"""

SQL = {
    "find_entities": f"WITH {E} SELECT id, name FROM e WHERE starts_with(lower(trim(name)), 'project') ORDER BY lower(trim(name)) = 'project' DESC, confidence DESC, access_count DESC, id LIMIT 20",
    "delete_entity": f"""WITH {E}, {T}, g AS (SELECT id FROM e WHERE entity_type = 'organisation')
 SELECT relation_type, count(*) AS n FROM t WHERE subject_id NOT IN (SELECT id FROM g) AND (object_id IS NULL OR object_id NOT IN (SELECT id FROM g)) GROUP BY relation_type""",
    "touch_access": f"""WITH {E}, {T}, h AS (SELECT subject_id AS s, object_id AS o FROM t WHERE valid_until IS NULL AND relation_type IN ('causal', 'depends')), x AS (SELECT s AS id FROM h UNION SELECT o FROM h WHERE o IS NOT NULL)
 SELECT e.id, CASE WHEN x.id IS NULL THEN access_count ELSE access_count + 1 END AS access_count, CASE WHEN x.id IS NOT NULL THEN true WHEN last_accessed IS NOT NULL THEN false END AS read_now FROM e LEFT JOIN x ON e.id = x.id""",
    "current_facts": f"WITH {T} SELECT predicate, count(*) AS n_open, round(avg(confidence), 6) AS avg_confidence FROM t WHERE valid_until IS NULL GROUP BY predicate",
    "as_of_facts": f"WITH {T} SELECT id, subject_id, predicate FROM t WHERE valid_from <= {AT} AND (valid_until IS NULL OR valid_until > {AT})",
    "fact_history": f"WITH {T} SELECT subject_id, predicate, id, CAST(row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, created_at, id) AS INTEGER) AS version FROM t WHERE valid_from IS NOT NULL",
    "scd2_facts": f"""WITH {T}, a AS (SELECT *, {_TAG} AS v, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, created_at, id) AS seq FROM t WHERE relation_type = 'fact' AND valid_from IS NOT NULL)
 SELECT a.id, a.valid_from, (SELECT arg_min(b.valid_from, b.seq) FROM a b WHERE b.subject_id = a.subject_id AND b.predicate = a.predicate AND b.seq > a.seq AND b.v <> a.v) AS valid_until FROM a""",
    "contradictions": f"WITH {T} SELECT subject_id, predicate, count(DISTINCT {_TAG}) AS n_values, count(*) AS n_facts FROM t WHERE valid_until IS NULL AND relation_type = 'fact' GROUP BY ALL HAVING n_values > 1",
    "triple_pattern": f"WITH {T} SELECT id, CAST(row_number() OVER (ORDER BY confidence DESC, created_at DESC, id) AS INTEGER) AS pos FROM t WHERE valid_until IS NULL AND predicate = 'maintainer' AND relation_type = 'fact'",
    "list_entities": f"""WITH {E}, {T}, x AS (SELECT subject_id AS i FROM t WHERE valid_until IS NULL UNION ALL SELECT object_id FROM t WHERE valid_until IS NULL AND object_id IS NOT NULL AND object_id <> subject_id)
 SELECT e.id, count(x.i) AS degree FROM e LEFT JOIN x ON x.i = e.id GROUP BY e.id""",
    "list_triples": f"WITH {E}, {T} SELECT t.id, md5({_TEXT}) AS text_md5 FROM {_NAMED}",
    "orphans": f"WITH {E}, {T} SELECT id FROM e WHERE id NOT IN (SELECT subject_id FROM t UNION SELECT object_id FROM t WHERE object_id IS NOT NULL)",
    "touched_entities": f"WITH {E}, {T} SELECT id FROM e WHERE id IN (SELECT subject_id FROM t WHERE relation_type = 'causal' UNION SELECT object_id FROM t WHERE relation_type = 'causal' AND object_id IS NOT NULL)",
    "duplicates": f"""WITH {E}, k AS (SELECT lower(trim(name)) AS key, count(*) AS n FROM e WHERE trim(name) <> '' GROUP BY 1)
 SELECT a.key AS key_a, b.key AS key_b, a.n AS n_a, b.n AS n_b FROM k a JOIN k b ON a.key = b.key AND a.n > 1 UNION ALL SELECT a.key, b.key, a.n, b.n FROM k a JOIN k b ON starts_with(b.key, a.key || ' ')""",
    "merge_entities": f"""WITH {E}, {T}, k AS (SELECT id, first_value(id) OVER (PARTITION BY lower(trim(name)) ORDER BY created_at, id) AS keep FROM e WHERE trim(name) <> '')
 SELECT coalesce(k.keep, t.subject_id) AS subject_id, count(*) AS n FROM t LEFT JOIN k ON k.id = t.subject_id GROUP BY 1""",
    "superseded_counts": f"WITH {T} SELECT subject_id, count(*) FILTER (valid_until IS NOT NULL) AS n_superseded, CAST(sum(access_count) AS BIGINT) AS n_accesses FROM t GROUP BY subject_id",
    "neighbours_3": f"""WITH RECURSIVE {T}, l AS (SELECT id, subject_id AS u, object_id AS v FROM t WHERE valid_until IS NULL UNION ALL SELECT id, object_id, subject_id FROM t WHERE valid_until IS NULL AND object_id IS NOT NULL AND object_id <> subject_id),
 s AS (SELECT unnest(CAST(entity_ids AS JSON)::VARCHAR[]) AS id FROM (SELECT entity_ids FROM clusters WHERE entity_ids <> '[]' ORDER BY id LIMIT 1)),
 h1 AS (SELECT DISTINCT l.id, l.v FROM l JOIN s ON l.u = s.id), h2 AS (SELECT DISTINCT l.id, l.v FROM l JOIN (SELECT DISTINCT v FROM h1 WHERE v IS NOT NULL) x ON l.u = x.v),
 h3 AS (SELECT DISTINCT l.id FROM l JOIN (SELECT DISTINCT v FROM h2 WHERE v IS NOT NULL) x ON l.u = x.v)
 SELECT id AS triple_id, CAST(min(d) AS INTEGER) AS depth FROM (SELECT id, 1 AS d FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id""",
    "dense_topk": f"WITH {_SIM} SELECT qid, id, round(score, 6) AS score, pos FROM top",
    "multi_probe_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS pos FROM s QUALIFY pos <= 10),
 u AS (SELECT qid, id, score FROM r WHERE qid % 100 = 0 UNION ALL SELECT a.qid, b.id, b.score * 0.5 / a.pos FROM r a JOIN r b ON a.qid % 100 = 0 AND a.pos <= 3 AND b.qid = a.id AND b.id <> a.qid),
 m AS (SELECT qid, id, max(score) AS score FROM u GROUP BY ALL)
 SELECT qid, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS pos FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 10""",
    "dense_expansion_flag": f"""WITH {_SIM}, p AS (SELECT qid, max(score) FILTER (pos = 1) AS s1, max(score) FILTER (pos = 2) AS s2, max(score) FILTER (pos = 5) AS s5 FROM top GROUP BY qid)
 SELECT qid, coalesce(s1 - s2 < 2 * (s2 - s5), false) AS expand FROM p""",
    "retrieval_metrics": f"""WITH {_METRIC} SELECT qid, recall_any_5, recall_all_5, round(ndcg_5, 6) AS ndcg_5, recall_any_10, recall_all_10, round(ndcg_10, 6) AS ndcg_10, round(ndcg_retrieved_10, 6) AS ndcg_retrieved_10 FROM mm""",
    "metric_by_label": f"""WITH {_METRIC} SELECT coalesce(label, -1) AS label, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_any_10), 6) AS recall_any_10, count(*) AS n FROM mm GROUP BY ROLLUP (label)""",
    "temporal_score": f"""WITH {T} SELECT id, round((0.6 + 0.3 * exp(-0.693 * (greatest({NOW} - created_at, 0.0) / 86400) / 30.0) + 0.1 * (1 + 0.1 * ln(1 + coalesce(access_count, 0)))) * confidence, 6) AS score FROM t""",
    "adjacency": f"WITH {T}, {_ADJ} SELECT src, dst, round(w, 6) AS w FROM adj",
    "weighted_degree": f"WITH {T}, {_ADJ} SELECT id, round(degree, 6) AS degree FROM deg",
    "laplacian_entries": f"""WITH {T}, {_ADJ} SELECT src, dst, round(sum(v), 6) AS v FROM (SELECT src, dst, -w / sqrt(a.degree * b.degree) AS v FROM adj JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE a.degree > 0 AND b.degree > 0
 UNION ALL SELECT id, id, 1.0 FROM deg WHERE degree > 0) GROUP BY src, dst""",
    "decay_operator": f"WITH {E}, {T}, {_ADJ}, {_DECAY} SELECT id, round(n, 6) AS new_confidence FROM dec",
    "promote_repeated": f"""WITH {T}, x AS (SELECT subject_id, predicate, coalesce(object_id, '') AS o, coalesce(object_value, '') AS v FROM t WHERE valid_until IS NULL GROUP BY ALL HAVING count(DISTINCT source_ref) >= 3)
 SELECT t.id, round(CASE WHEN x.o IS NOT NULL AND t.valid_until IS NULL THEN least(confidence * 1.5, 1.0) ELSE confidence END, 6) AS confidence
 FROM t LEFT JOIN x ON t.subject_id = x.subject_id AND t.predicate = x.predicate AND coalesce(t.object_id, '') = x.o AND coalesce(t.object_value, '') = x.v""",
    "dedup_triples": f"""WITH {T} SELECT id FROM t WHERE valid_until IS NOT NULL UNION ALL SELECT id FROM (SELECT id FROM t WHERE valid_until IS NULL
 QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id, object_value, relation_type ORDER BY confidence DESC NULLS LAST, created_at DESC NULLS LAST, id) = 1)""",
    "self_references": f"WITH {T} SELECT relation_type, count(*) AS n FROM t WHERE NOT (valid_until IS NULL AND coalesce(object_id = subject_id, false)) GROUP BY relation_type",
    "prune": f"""WITH {T}, p AS (SELECT predicate, valid_until IS NULL AS o, relation_type = 'fact' AND confidence < 0.3 AS g FROM t)
 SELECT predicate, count(*) FILTER (o AND g) AS n_pruned, count(*) FILTER (o AND NOT coalesce(g, false)) AS n_open FROM p GROUP BY predicate""",
    "decay_triples": f"""WITH {E}, {T.replace("t AS (", "t0 AS (")}, t AS (SELECT * FROM t0 WHERE NOT (valid_until IS NULL AND coalesce(object_id = subject_id, false))), {_ADJ}, {_DECAY},
 f AS (SELECT id, n / greatest(c, 0.01) AS f FROM dec WHERE abs(n - c) > 0.01),
 x AS (SELECT t.id, valid_until, confidence, a.f AS f1, b.f AS f2 FROM t LEFT JOIN f a ON a.id = CASE WHEN object_id IS NULL THEN subject_id ELSE least(subject_id, object_id) END
  LEFT JOIN f b ON object_id <> subject_id AND b.id = greatest(subject_id, object_id)),
 y AS (SELECT *, CASE WHEN f1 IS NULL THEN confidence ELSE least(greatest(confidence * f1, 0.0), 1.0) END AS c1 FROM x)
 SELECT id, round(CASE WHEN valid_until IS NOT NULL THEN confidence WHEN f2 IS NULL THEN c1 ELSE least(greatest(c1 * f2, 0.0), 1.0) END, 6) AS confidence FROM y""",
    "cluster_centroid": f"""WITH {E}, m AS (SELECT DISTINCT id AS cluster_id, unnest(CAST(entity_ids AS JSON)::VARCHAR[]) AS id FROM clusters),
 u AS (SELECT id, embedding FROM e WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
 x AS (SELECT cluster_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM m JOIN u USING (id)), a AS (SELECT cluster_id, i, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL)
 SELECT cluster_id, max(n) AS n, round(sum(x * x), 6) AS squared_norm FROM a GROUP BY cluster_id""",
    "graph_stats": f"""WITH {T} SELECT (SELECT count(DISTINCT lower(trim(id))) FROM entities) AS n_entities, count(*) FILTER (valid_until IS NULL) AS n_open, count(*) FILTER (valid_until IS NOT NULL) AS n_closed,
 count(object_id) AS n_edges FROM t""",
}


def _fused() -> None:
    from sediment.plans.texts import _DOCS, _bm25

    okapi, plus = _bm25(_DOCS, TOKENS, "okapi"), _bm25(_DOCS, TOKENS, "plus")
    top = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"
    SQL["compare_runs"] = f"""WITH a AS (SELECT * FROM ({okapi} SELECT * FROM sc) QUALIFY {top} <= 20), b AS (SELECT * FROM ({plus} SELECT * FROM sc) QUALIFY {top} <= 20)
 SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(a.score, 6) AS value_a, round(b.score, 6) AS value_b, round(b.score - a.score, 6) AS delta,
 CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' WHEN a.score = b.score THEN 'equal' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id"""
    near = f"""v AS (SELECT id, {HASHED.format("toks")} AS v FROM k WHERE len(toks) > 0), qv AS (SELECT qid, {HASHED.format(TOKENS.format("text"))} AS v FROM q),
 nr AS (SELECT qid, id, list_cosine_similarity(qv.v, v.v) AS score FROM v, qv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv.v, v.v), 9) DESC, id) <= 60)"""
    fuse = """j AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, greatest(coalesce(a.score, 0.0), 0.0) AS dn, coalesce(b.score, 0.0) AS lx FROM {} a FULL JOIN sc b ON a.qid = b.qid AND a.id = b.id),
 f2 AS (SELECT qid, id, round(CASE WHEN max(dn) OVER w > 0 THEN 0.7 * dn / max(dn) OVER w ELSE 0.0 END + CASE WHEN max(lx) OVER w > 0 THEN 0.3 * lx / max(lx) OVER w ELSE 0.0 END, 9) AS score FROM j WINDOW w AS (PARTITION BY qid))"""
    SQL["hybrid_stage1"] = _bm25(_DOCS, TOKENS, "okapi", digits=15) + f""", {near}, {fuse.format("nr")}
 SELECT qid, id, round(score, 6) AS score, CAST({top} AS INTEGER) AS pos FROM f2 QUALIFY {top} <= 20"""
    sd = f"""{M}, y AS (SELECT * FROM m WHERE session_id IS NOT NULL AND trim(content) <> ''),
 sd AS (SELECT session_id AS id, string_agg(content, chr(10) ORDER BY ts, id) FILTER (role IN ('user', 'human')) AS text, string_agg(content, chr(10) ORDER BY ts, id) AS all_text FROM y GROUP BY session_id HAVING text IS NOT NULL), """
    share = lambda a: f"len(list_filter(list_distinct({TOKENS.format('q.text')}), lambda t: list_contains({TOKENS.format(a)}, t))) / len(list_distinct({TOKENS.format('q.text')}))"
    SQL["retrieve_sessions"] = _bm25("SELECT id, text FROM sd", TOKENS, "okapi", sd, digits=15) + f""", {near},
 ps AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS pos FROM nr),
 ld AS (SELECT qid, max(score) FILTER (pos = 1) AS s1, max(score) FILTER (pos = 2) AS s2, max(score) FILTER (pos = 5) AS s5, max(id) FILTER (pos = 1) AS id, list(score) AS every FROM ps GROUP BY qid),
 mo AS (SELECT qid, id FROM ld WHERE s5 IS NOT NULL AND (s1 - s2 < (s2 - s5) * 2.0 OR len(list_filter(every, lambda s: s >= s1 * 0.9)) >= 3)),
 ax AS (SELECT qid, q.text || ' ' || substr(sd.text, 1, 200) AS text FROM mo JOIN sd USING (id) JOIN q USING (qid)), av AS (SELECT qid, {HASHED.format(TOKENS.format("text"))} AS v FROM ax),
 ag AS (SELECT qid, id, 0.5 * list_cosine_similarity(av.v, v.v) AS score FROM v, av QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(av.v, v.v), 9) DESC, id) <= 20),
 dd AS (SELECT qid, id, max(score) AS score FROM (SELECT qid, id, score FROM nr UNION ALL SELECT * FROM ag) GROUP BY ALL), {fuse.format("dd")},
 cd AS (SELECT * FROM f2 QUALIFY {top} <= 15),
 rr AS (SELECT cd.*, greatest({share("substr(sd.text, 1, 512)")}, {share("substr(sd.all_text, 1, 512)")}) AS rerank FROM cd JOIN sd USING (id) JOIN q USING (qid)),
 bl AS (SELECT qid, id, 0.4 * CASE WHEN max(rerank) OVER w > min(rerank) OVER w THEN (rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w) ELSE 0.5 END + 0.6 * CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0.0 END AS fin FROM rr WINDOW w AS (PARTITION BY qid)),
 bo AS (SELECT qid, min(fin) AS least FROM bl GROUP BY qid),
 al AS (SELECT f2.qid, f2.id, round(coalesce(fin, CASE WHEN max(score) OVER (PARTITION BY f2.qid) > 0 THEN score / max(score) OVER (PARTITION BY f2.qid) * least * 0.99 ELSE 0.0 END), 9) AS score FROM f2 JOIN bo USING (qid) LEFT JOIN bl ON bl.qid = f2.qid AND bl.id = f2.id)
 SELECT qid, id, round(score, 6) AS score, CAST({top} AS INTEGER) AS pos FROM al QUALIFY {top} <= 10"""
    # facets of the queries that are asked, written out: number * 4 + facet, text, name
    faceted = [(q * 4, t, None) for q, t in COMPARED] + [(25, "Norwick Bay tariff model", "norwick bay"), (26, "Greyfen tariff model", "greyfen")]
    fq = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if n is None else repr(n)})" for i, t, n in faceted) + ") AS v(qid, text, name))"
    SQL["grouped_sessions"] = _bm25("SELECT id, content AS text FROM m WHERE session_id IS NOT NULL", TOKENS, "okapi", f"{M}, ").replace(Q, fq) + f""",
 p2 AS (SELECT id, session_id AS parent, content AS text FROM m WHERE session_id IS NOT NULL), v AS (SELECT id, {HASHED.format("toks")} AS v FROM k), qv AS (SELECT qid, {HASHED.format(TOKENS.format("text"))} AS v FROM q),
 s1 AS (SELECT qid, id, list_cosine_similarity(qv.v, v.v) AS c FROM v, qv), dn AS (SELECT qid, id, rank() OVER (PARTITION BY qid ORDER BY round(CASE WHEN isnan(c) OR c IS NULL THEN 0.0 ELSE c END, 9) DESC) AS dr FROM s1),
 lx AS (SELECT qid, id, rank() OVER (PARTITION BY qid ORDER BY score DESC) AS lr FROM sc WHERE score > 0), nn AS (SELECT qid, count(*) + 1 AS none FROM lx GROUP BY qid),
 rk AS (SELECT dn.qid AS qf, dn.qid // 4 AS qid, dn.qid % 4 AS facet, dn.id, parent, dr, coalesce(lr, none, 1) AS lr FROM dn JOIN p2 USING (id) LEFT JOIN lx ON lx.qid = dn.qid AND lx.id = dn.id LEFT JOIN nn ON nn.qid = dn.qid),
 hs AS (SELECT DISTINCT qid AS qf, parent FROM p2, q WHERE name IS NOT NULL AND regexp_matches(' ' || lower(p2.text) || ' ', '[^\\p{{L}}\\p{{N}}_]' || name || '[^\\p{{L}}\\p{{N}}_]')),
 be AS (SELECT qid, qf, facet, parent, min(dr) AS dr, min(lr) AS lr FROM rk GROUP BY ALL),
 pa AS (SELECT be.qid, be.parent, avg(CASE WHEN facet = 0 OR hs.parent IS NOT NULL THEN 1.0 / (60 + dr) + 1.0 / (60 + lr) ELSE 0.0 END) AS score FROM be LEFT JOIN hs ON hs.qf = be.qf AND hs.parent = be.parent GROUP BY ALL),
 ch AS (SELECT qid, id FROM rk QUALIFY row_number() OVER (PARTITION BY qf ORDER BY dr, id) <= 60 OR row_number() OVER (PARTITION BY qf ORDER BY lr, id) <= 60),
 st AS (SELECT qid, id, any_value(parent) AS parent, round(avg(1.0 / (60 + dr) + 1.0 / (60 + lr)), 12) AS score FROM rk SEMI JOIN ch USING (qid, id) GROUP BY qid, id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(avg(1.0 / (60 + dr) + 1.0 / (60 + lr)), 12) DESC, id) <= 30),
 cr AS (SELECT st.qid, parent, {share("coalesce(p3.text, '')")} AS x FROM st JOIN (SELECT id, text FROM p2) p3 USING (id) JOIN q ON q.qid = st.qid * 4), cx AS (SELECT qid, parent, rank() OVER (PARTITION BY qid ORDER BY x DESC) AS r FROM cr),
 cy AS (SELECT qid, parent, min(r) AS r FROM cx GROUP BY ALL), fi AS (SELECT pa.qid, pa.parent, round(pa.score + coalesce(0.5 / (60 + r), 0.0), 9) AS score FROM pa LEFT JOIN cy USING (qid, parent))
 SELECT qid, parent, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) AS INTEGER) AS pos FROM fi QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) <= 10"""

_fused()
assert Q
