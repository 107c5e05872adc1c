"""Queries on texts, lexical ranking, storage and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.functions import text as X
from sediment.operators import consolidation, ingest, retrieval, search, temporal
from sediment.operators.lexical import Matched, bm25, bm25_many, top_k
from sediment.plans.base import AT, M, NOW, Q, TOKENS, asked, entities, messages, triples
from sediment.sources import archive, store
from sediment.sources.tables import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("content is not null")


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("text")).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("id", X.token_estimate(F.col("content")).alias("n_words"))


def extract_names(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select(F.explode(X.proper_names(F.col("content"))).alias("name")).groupBy("name").agg(F.count("*").alias("n_messages"))


def extract_quoted(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("id", F.posexplode(X.quoted(F.concat_ws("\n", "content", "metadata"))).alias("pos", "quoted"))


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    f = _said(spark, d).select(F.explode(X.facts(F.col("content"))).alias("f")).select("f.*")
    return f.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    w = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(X.windows(X.sentences(F.col("text")))).alias("w"))
    return w.select("doc_id", "w.start", F.md5("w.text").alias("text_md5"))


def turn_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four turns at every second one, by numbering the turns of a session: a turn belongs to at most three windows."""
    m = messages(spark, d).where("session_id is not null")
    m = m.withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    w = m.select("session_id", F.explode(X.windows_of(F.col("i"), F.col("n"))).alias("start"), "content")
    return w.groupBy("session_id", "start").agg(F.count("*").alias("n_turns"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("n_chars"))


def durable_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("id", X.durable_candidate(F.col("role"), F.col("content")).alias("c"), X.durable_excerpt(F.col("content")).alias("e"))
    return m.where("c is not null").select("id", "c.*", F.length("e").alias("excerpt_chars"))


def session_turns(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where("session_id is not null")
    return m.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "id")).alias("pos"))


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).orderBy(F.desc("timestamp"), "id").limit(50).select("id", "timestamp", "role")


def session_markdown(spark: SparkSession, d: str) -> DataFrame:
    return archive.markdown(messages(spark, d)).select("session_id", F.md5("markdown").alias("markdown_md5"))


def retention_candidates(spark: SparkSession, d: str) -> DataFrame:
    return archive.retention(messages(spark, d), before=AT, keep_latest=100).select("id")


def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All messages through archive lines and back: counts of good lines, bad lines, and lines that differ from their message."""
    m = messages(spark, d)
    back = archive.decode(archive.encode(m).select("value"))
    both = m.select(F.struct(*archive.FIELDS).alias("was"), "id").join(back.where("ok").select(F.struct(*archive.FIELDS).alias("now"), "id"), "id", "left")
    changed = both.where(~F.col("was").eqNullSafe(F.col("now"))).agg(F.count("*").alias("n_changed"))
    return back.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad")).crossJoin(F.broadcast(changed))


def restore_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    old = archive.decode(archive.encode(m).select("value"))
    return archive.restore(m.where(F.col("timestamp") >= AT), old).groupBy((F.col("timestamp") < AT).alias("restored")).agg(F.count("*").alias("n"))


def raw_usage(spark: SparkSession, d: str) -> DataFrame:
    return store.usage(messages(spark, d), entities(spark, d), triples(spark, d))


def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    return store.integrity(entities(spark, d), triples(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_okapi_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(top_k(bm25(_documents(spark, d), asked(spark)).withColumn("score", F.round("score", 9)), 10))


def bm25_plus_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(top_k(bm25(_documents(spark, d), asked(spark), "plus").withColumn("score", F.round("score", 9)), 10))


def bm25_whitespace_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(top_k(bm25(_documents(spark, d), asked(spark), tokenise=X.white_tokens).withColumn("score", F.round("score", 9)), 10))


def fts_search(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("id", F.col("content").alias("text"))
    return _rounded(top_k(bm25(m, asked(spark), "fts").withColumn("score", F.round("score", 9)), 10))


def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """All held-out passages as queries over all documents."""
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("item_text").alias("text"))
    return _rounded(bm25_many(_documents(spark, d), q, 10))


def window_bm25_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Sentence windows of documents ranked, their scores collapsed to the document's largest."""
    w = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(X.windows(X.sentences(F.col("text")))).alias("w"))
    w = w.select(F.concat_ws("#", "doc_id", "w.start").alias("id"), F.col("doc_id").alias("parent"), F.col("w.text").alias("text"))
    scores = bm25(w, asked(spark), keep=("parent",)).groupBy("qid", "parent").agg(F.round(F.max("score"), 9).alias("score"))
    return _rounded(top_k(scores, 10, tie="parent"))


def competition_ranks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("court", "doc_id", F.col("n_chars").alias("score"))
    return retrieval.competition_ranks(t, "court").select("court", "doc_id", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Okapi and plus rankings of the documents fused by reciprocal ranks."""
    matched = Matched(_documents(spark, d), asked(spark))
    ranks = [top_k(matched.score(v).withColumn("score", F.round("score", 9)), 50).select("qid", "id", (F.col("pos") - 1).alias("rank")) for v in ("okapi", "plus")]
    return _rounded(top_k(retrieval.rrf(ranks[0].unionByName(ranks[1])).withColumn("score", F.round("score", 9)), 10))


def ingest_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Facts extracted from all messages, superseding each other, in order of arrival."""
    a = ingest.assertions(ingest.extract(_said(spark, d)))
    a = temporal.supersede(a.withColumnRenamed("object_key", "value"), ["subject_key", "predicate"])
    return a.select("subject_key", "predicate", "value", "links", "valid_from", "valid_until")


def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names in messages against the stored entities."""
    m = ingest.extract(_said(spark, d)).select(F.explode("names").alias("name"), F.lit(None).cast("string").alias("entity_type"), F.col("timestamp").alias("at"))
    r = ingest.resolve(m, entities(spark, d))
    return r.select("name_key", "entity_type", F.round("created_at", 3).alias("created_at"), "is_new")


def boolean_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages that meet an expression of words and phrases."""
    return messages(spark, d).where(search.matches(F.col("content"), '"rollback steps" OR (ledger AND currency) OR (Greyfen NOT office)')).select("id")


def session_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.session_documents(messages(spark, d)).select("session_id", F.md5("user_text").alias("user_md5"), F.md5("all_text").alias("all_md5"))


def paired_events(spark: SparkSession, d: str) -> DataFrame:
    """The n-th view of each user with the n-th purchase."""
    e = table(spark, d, "events")
    kinds = e.groupBy().agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    p = search.pair_events(e, "user_id", "ts", "event_type", kinds.a, kinds.b)
    return p.groupBy("user_id").agg(F.count("*").alias("n_opened"), F.count("closed").alias("n_closed"))


def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = _said(spark, d).select(F.col("id").alias("grp"), X.proper_names(F.col("content")).alias("names"))
    return consolidation.cooccurrence(items)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, document_frequency, token_estimate, extract_names, extract_quoted, extract_facts, sentence_windows, turn_windows, durable_candidates, session_turns, recent_turns,
        session_markdown, retention_candidates, archive_round_trip, restore_skip_existing, raw_usage, integrity_check, bm25_okapi_topk, bm25_plus_topk, bm25_whitespace_topk, fts_search, bm25_batch_topk,
        window_bm25_collapse, competition_ranks, rrf_fusion, ingest_assertions, resolve_entities, cooccurrence_pairs, boolean_search, session_documents, paired_events,
    )
}

# RE2 has no look-behind, so its words are set between two marks, which stand for their bounds and are taken out again
_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"
_MARKED = "regexp_replace(translate(content, chr(1) || chr(2), '  '), '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g')"
_CAPITALS = f"\\x01([A-Z][a-z]+(?:\\x02{_BLANK}\\x01[A-Z][a-z]+)*)\\x02"
_RAW_NAMES = f"list_transform(regexp_extract_all({_MARKED}, '{_CAPITALS}', 1), lambda x: translate(x, chr(1) || chr(2), ''))"
_NAMES = f"list_filter(list_distinct({_RAW_NAMES}), lambda x: length(x) > 2)"
_FIRST = "list_filter(list_filter(r, lambda x, i: list_position(r, x) = i), lambda x: length(x) > 2)"
_VERB = "uses?|is|was|has|prefers?|decided|switched\\x02 \\x01to|moved\\x02 \\x01to"
_TWO = f"\\x01[^\\x01\\x02]+(?:\\x02{_BLANK}\\x01[^\\x01\\x02]+)?\\x02"
_FACT = f"(?i)({_TWO}){_BLANK}\\x01({_VERB})\\x02{_BLANK}({_TWO})"
_BARE = "translate({}, chr(1) || chr(2), '')"
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


def _bm25(docs: str, tok: str, variant: str, ctes: str = "", digits: int = 9) -> str:
    k = 1.2 if variant == "fts" else 1.5
    if variant == "plus":
        idf = "ln((n + 1) / df)"
    elif variant == "fts":
        idf = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
    else:
        idf = "CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END"
    return f"""WITH {ctes}{Q}, d AS ({docs}),
 k AS (SELECT id, {tok.format("coalesce(text, '')")} AS toks FROM d),
 p AS (SELECT id, term, len(toks) AS dl, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM k) GROUP BY ALL),
 s AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS n, (SELECT sum(tf) FROM p)::DOUBLE / (SELECT count(*) FROM d) AS avgdl),
 f AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
 i AS (SELECT term, avgdl, {idf} AS idf FROM f),
 w AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok.format("text")}) AS term FROM q) GROUP BY ALL),
 sc AS (SELECT qid, id, round(sum(qtf * idf * tf * {k + 1} / (tf + {k} * (0.25 + 0.75 * dl / avgdl))), {digits}) AS score FROM p JOIN w USING (term) JOIN i USING (term) GROUP BY qid, id)"""


_TOP = " SELECT qid, id, round(score, 6) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM sc) WHERE pos <= 10"
_DOCS = "SELECT doc_id AS id, text FROM documents"

def _cue(words: str) -> str:
    return f"regexp_matches({_MARKED}, '(?i)\\x01(?:" + words.replace(" ", "\\x02 \\x01") + ")\\x02')"


_STRIP = f"regexp_replace({{}}, '^{_BLANK}|{_BLANK}$', '', 'g')"
_LINES = "list_transform(string_split_regex(regexp_replace(content, '(?s)```.*?```', '', 'g'), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda x: " + _STRIP.replace("{}", "x") + ")"
_KEPT = f"list_transform(list_filter({_LINES}, lambda x: x <> '' AND NOT starts_with(x, 'http://') AND NOT starts_with(x, 'https://')), lambda x: regexp_replace(x, '^#{{1,6}}{_BLANK}', ''))"
_EXCERPT = _STRIP.replace("{}", f"substr(array_to_string({_KEPT}, chr(10)), 1, 2400)")

SQL = {
    "durable_candidates": f"""WITH {M}, x AS (SELECT id, role, content, {_EXCERPT} AS e FROM m WHERE NOT regexp_matches(content, '{X.SECRET_CUES}')),
 k AS (SELECT id, length(e) AS n, CASE WHEN role IN ('user', 'human') AND {_cue(X.USER_GLOBAL_CUES)} THEN 1 WHEN role IN ('user', 'human') AND {_cue(X.USER_PROJECT_CUES)} THEN 2
  WHEN role IN ('assistant', 'bot', 'ai') AND {_cue(X.ASSISTANT_OUTCOME_CUES)} AND e <> '' THEN 3 END AS k FROM x)
 SELECT id, CASE k WHEN 1 THEN 'global' ELSE 'project' END AS scope, CASE k WHEN 1 THEN 'user_preference' WHEN 2 THEN 'project_fact' ELSE 'work_outcome' END AS kind,
  CASE k WHEN 3 THEN 'assistant_reported' ELSE 'user_stated' END AS verification, CASE k WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS confidence, CAST(n AS INTEGER) AS excerpt_chars FROM k WHERE k IS NOT NULL""",
    "boolean_search": f"""WITH {M}, p AS (SELECT id, ' ' || array_to_string({TOKENS.format("coalesce(content, '')")}, ' ') || ' ' AS s FROM m)
 SELECT id FROM p WHERE contains(s, ' rollback steps ') OR (contains(s, ' ledger ') AND contains(s, ' currency ')) OR (contains(s, ' greyfen ') AND NOT contains(s, ' office '))""",
    "session_documents": f"""WITH {M}, x AS (SELECT * FROM m WHERE session_id IS NOT NULL AND trim(content) <> '')
 SELECT session_id, md5(string_agg(content, chr(10) ORDER BY ts, id) FILTER (role IN ('user', 'human'))) AS user_md5, md5(string_agg(content, chr(10) ORDER BY ts, id)) AS all_md5 FROM x GROUP BY session_id HAVING user_md5 IS NOT NULL""",
    "paired_events": """WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), o AS (SELECT user_id, count(*) FILTER (event_type = a) AS x, count(*) FILTER (event_type = b) AS y FROM events, k GROUP BY user_id)
 SELECT user_id, x AS n_opened, least(x, y) AS n_closed FROM o WHERE x > 0""",
    "tokenize_counts": f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS INTEGER) AS n_tokens FROM documents",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) GROUP BY term",
    "token_estimate": f"WITH {M} SELECT id, CAST(coalesce(len(regexp_extract_all(content, '[^\\s]+')), 0) AS INTEGER) AS n_words FROM m",
    "extract_names": f"WITH {M} SELECT name, count(*) AS n_messages FROM (SELECT unnest({_NAMES}) AS name FROM m) GROUP BY name",
    "extract_quoted": f"""WITH {M}, x AS (SELECT id, regexp_extract_all(concat_ws(chr(10), content, metadata), '"([^"]+)"', 1) AS l FROM m) SELECT id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS quoted FROM x""",
    "extract_facts": f"""WITH {M}, x AS (SELECT unnest(regexp_extract_all({_MARKED}, '{_FACT}', 0)) AS w FROM m)
 SELECT {_BARE.format(f"regexp_extract(w, '{_FACT}', 1)")} AS subject, replace(lower({_BARE.format(f"regexp_extract(w, '{_FACT}', 2)")}), ' ', '_') AS predicate, {_BARE.format(f"regexp_extract(w, '{_FACT}', 3)")} AS object, count(*) AS n FROM x GROUP BY ALL""",
    "sentence_windows": f"""WITH s AS (SELECT doc_id, {_SENT} AS l FROM documents),
 w AS (SELECT doc_id, l, unnest(list_distinct(list_append(range(0, greatest(0, len(l) - 4) + 1, 2), greatest(0, len(l) - 4)))) AS start FROM s WHERE len(l) > 0)
 SELECT doc_id, CAST(start AS INTEGER) AS start, md5(array_to_string(l[start + 1 : start + 4], ' ')) AS text_md5 FROM w""",
    "turn_windows": f"""WITH {M}, x AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM m WHERE session_id IS NOT NULL),
 s AS (SELECT DISTINCT session_id, unnest(list_append(range(0, greatest(0, n - 4) + 1, 2), greatest(0, n - 4))) AS start FROM x)
 SELECT session_id, CAST(start AS INTEGER) AS start, count(*) AS n_turns, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS n_chars FROM s JOIN x USING (session_id) WHERE i >= start AND i < start + 4 GROUP BY ALL""",
    "session_turns": f"WITH {M} SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) AS pos FROM m WHERE session_id IS NOT NULL",
    "recent_turns": f'WITH {M} SELECT id, ts AS "timestamp", role FROM m ORDER BY ts DESC, id LIMIT 50',
    "session_markdown": f"""WITH {M} SELECT session_id, md5(string_agg('**' || coalesce(role, 'unknown') || '**: ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY ts, id)) AS markdown_md5 FROM m WHERE session_id IS NOT NULL GROUP BY session_id""",
    "retention_candidates": f"WITH {M} SELECT id FROM m WHERE ts < {AT} AND id NOT IN (SELECT id FROM m ORDER BY ts DESC, id DESC LIMIT 100)",
    "archive_round_trip": f"WITH {M} SELECT count(*) AS n_ok, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS n_changed FROM m",
    "restore_skip_existing": f"WITH {M} SELECT ts < {AT} AS restored, count(*) AS n FROM m GROUP BY 1",
    "raw_usage": f"""WITH {M}, e AS (SELECT lower(trim(id)) AS id, any_value(embedding) AS v FROM entities GROUP BY 1)
 SELECT (SELECT count(*) FROM m) AS n_messages, (SELECT CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) FROM m) AS text_bytes, (SELECT count(*) FROM e) AS n_entities,
 (SELECT CAST(coalesce(sum(len(v) * 4), 0) AS BIGINT) FROM e) AS vector_bytes, (SELECT count(DISTINCT lower(trim(id))) FROM triples) AS n_triples""",
    "integrity_check": """WITH t AS (SELECT lower(trim(id)) AS id, any_value(lower(trim(subject_id))) AS s, any_value(lower(trim(object_id))) AS o, any_value(object_value) AS v, any_value(relation_type) AS r, any_value(confidence) AS c FROM triples GROUP BY 1),
 i AS (SELECT DISTINCT lower(trim(id)) AS id FROM entities)
 SELECT 'lost_subject_id' AS problem, count(*) AS n FROM t ANTI JOIN i ON t.s = i.id UNION ALL SELECT 'lost_object_id', count(*) FROM (SELECT * FROM t WHERE o IS NOT NULL) t ANTI JOIN i ON t.o = i.id
 UNION ALL SELECT 'relation', count(*) FROM t WHERE r NOT IN ('fact', 'causal', 'depends', 'supersedes', 'contradicts') UNION ALL SELECT 'object', count(*) FROM t WHERE (o IS NULL) = (v IS NULL)
 UNION ALL SELECT 'confidence', count(*) FROM t WHERE c < 0 OR c > 1""",
    "bm25_okapi_topk": _bm25(_DOCS, TOKENS, "okapi") + _TOP,
    "bm25_batch_topk": _bm25(_DOCS, TOKENS, "okapi").replace(Q, "q AS (SELECT item_id AS qid, item_text AS text FROM eval_items)") + _TOP,
    "bm25_plus_topk": _bm25(_DOCS, TOKENS, "plus") + _TOP,
    "bm25_whitespace_topk": _bm25(_DOCS, "string_split({}, ' ')", "okapi") + _TOP,
    "fts_search": _bm25("SELECT id, content AS text FROM m", TOKENS, "fts", f"{M}, ") + _TOP,
    "window_bm25_collapse": _bm25(
        "SELECT doc_id || '#' || start AS id, array_to_string(l[start + 1 : start + 4], ' ') AS text FROM wn", TOKENS, "okapi",
        f"""se AS (SELECT doc_id, {_SENT} AS l FROM documents),
 wn AS (SELECT doc_id, l, unnest(list_distinct(list_append(range(0, greatest(0, len(l) - 4) + 1, 2), greatest(0, len(l) - 4)))) AS start FROM se WHERE len(l) > 0), """,
    )
    + """, mx AS (SELECT qid, CAST(split_part(id, '#', 1) AS BIGINT) AS parent, max(score) AS score FROM sc GROUP BY ALL)
 SELECT qid, parent, round(score, 6) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) AS pos FROM mx) WHERE pos <= 10""",
    "competition_ranks": "SELECT court, doc_id, CAST(rank() OVER (PARTITION BY court ORDER BY n_chars DESC) AS INTEGER) AS rank FROM documents",
    "resolve_entities": f"""WITH {M}, n AS (SELECT lower(trim(unnest(list_concat({_NAMES}, regexp_extract_all(content, '"([^"]+)"', 1))))) AS k, ts FROM m),
 n2 AS (SELECT k, min(ts) AS ts FROM n WHERE k <> '' GROUP BY k),
 e AS (SELECT lower(trim(name)) AS k, entity_type, created_at AS c FROM (SELECT DISTINCT ON (lower(trim(id))) * FROM entities) WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY created_at, lower(trim(id))) = 1)
 SELECT coalesce(e.k, n2.k) AS name_key, e.entity_type, round(coalesce(e.c, n2.ts), 3) AS created_at, e.k IS NULL AS is_new FROM e FULL JOIN n2 ON e.k = n2.k""",
    "cooccurrence_pairs": f"""WITH {M}, y AS (SELECT id, {_RAW_NAMES} AS r FROM m), l AS (SELECT id, {_FIRST} AS l FROM y), x AS (SELECT id, unnest(l) AS x, unnest(range(len(l))) AS i FROM l)
 SELECT least(p.x, r.x) AS a, greatest(p.x, r.x) AS b, count(*) AS n FROM x p JOIN x r ON p.id = r.id AND r.i > p.i AND r.i < p.i + 5 AND p.x <> r.x GROUP BY ALL""",
}

_O, _P = _bm25(_DOCS, TOKENS, "okapi"), _bm25(_DOCS, TOKENS, "plus")
SQL["rrf_fusion"] = f"""SELECT qid, id, round(score, 6) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM (
 SELECT qid, id, round(sum(1.0 / (59 + p)), 9) AS score FROM (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS p FROM ({_O} SELECT * FROM sc) UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) FROM ({_P} SELECT * FROM sc))
 WHERE p <= 50 GROUP BY qid, id)) WHERE pos <= 10"""
assert NOW > AT
