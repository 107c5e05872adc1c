"""Ranking by several kinds of evidence: fusion, rank fusion, blending, decay, grouped windows and fact recall."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.text import AFTER, BEFORE, tokens
from sediment.operators.dense import exact_top_k
from sediment.operators.lexical import bm25, top_k
from sediment.session import cut, small_side

# The weights of fusion, blending and decay.
DENSE, LEXICAL = 0.70, 0.30
RERANK, STAGE1 = 0.40, 0.60
RRF = 60
CANDIDATES = {"speed": 20, "balanced": 15, "quality": 20}


def stage1(dense: DataFrame, lexical: DataFrame, by: str = "qid") -> DataFrame:
    """0.70 dense / largest dense + 0.30 lexical / largest lexical; a lexical part only if its largest is positive, dense below 0 counts as 0. Missing scores are 0."""
    both = dense.select(by, "id", F.col("score").alias("dense")).join(lexical.select(by, "id", F.col("score").alias("lexical")), [by, "id"], "full").fillna(0.0, ["dense", "lexical"])
    both = both.withColumn("dense", F.greatest("dense", F.lit(0.0)))
    top = both.groupBy(by).agg(F.max("dense").alias("_d"), F.max("lexical").alias("_l"))
    part = lambda c, m, w: F.when(F.col(m) > 0, w * F.col(c) / F.col(m)).otherwise(0.0)
    return both.join(top, by).withColumn("score", part("dense", "_d", DENSE) + part("lexical", "_l", LEXICAL)).drop("_d", "_l")


def final_blend(ranked: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """``ranked``: ``id``, ``score`` (stage 1), ``rerank``. The best ``k`` get 0.40 of the rerank score between its bounds (0.5 if all are equal) + 0.60 of
    stage 1 by its largest; the others stay below them in their order. Adds ``final``."""
    df = ranked.withColumn("_pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))
    w = Window.partitionBy(by)
    cand = F.col("_pos") <= k
    lo, hi, top = F.min(F.when(cand, F.col("rerank"))).over(w), F.max(F.when(cand, F.col("rerank"))).over(w), F.max("score").over(w)
    df = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_top", top)
    share = F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0)
    mm = F.when(F.col("_hi") > F.col("_lo"), (F.col("rerank") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    df = df.withColumn("_blend", F.when(cand, RERANK * mm + STAGE1 * share))
    df = df.withColumn("final", F.when(cand, F.col("_blend")).otherwise(share * F.min("_blend").over(w) * 0.99))
    return df.drop("_pos", "_lo", "_hi", "_top", "_blend")


def decay(age_s: Column, access: Column, half_life_days: float = 30.0) -> Column:
    """0.6 + 0.3 exp(-0.693 age / half life) + 0.1 (1 + 0.1 ln(1 + accesses)); ages below 0 count as 0."""
    days = F.greatest(age_s, F.lit(0.0)) / 86400
    return 0.6 + 0.3 * F.exp(F.lit(-0.693) * days / half_life_days) + 0.1 * (1 + 0.1 * F.log1p(F.coalesce(access, F.lit(0))))


def competition_ranks(scores: DataFrame, by: str, score: str = "score", buckets: int = 1000) -> DataFrame:
    """Ranks from the highest score down; equal scores share one and leave gaps; NaN and null come last, as one.

    The scores of a group are counted in ``buckets`` equal intervals; a rank is that inside its interval plus the counts before, so no task sorts a whole group.
    """
    clean = F.when(F.isnan(score), None).otherwise(F.col(score))
    s = scores.withColumn("_s", clean)
    ends = s.groupBy(by).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    at = F.when(F.col("_s").isNull(), buckets).when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_hi") - F.col("_s")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
    s = s.join(small_side(ends), by).withColumn("_bucket", at.cast("int"))
    before = s.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(small_side(before), [by, "_bucket"])
    rank = F.rank().over(Window.partitionBy(by, "_bucket").orderBy(F.col("_s").desc_nulls_last())) + F.col("_n")
    return s.withColumn("rank", rank.cast("int")).select(*scores.columns, "rank")


def rrf(rankings: DataFrame, by: str = "qid", k: int = RRF) -> DataFrame:
    """``rankings``: ``id``, ``rank`` (from 0) in any number of rankings. Sum of 1 / (k + rank)."""
    return rankings.groupBy(by, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def grouped_sessions(dense: DataFrame, lexical: DataFrame, windows: DataFrame) -> DataFrame:
    """Parents by fused window ranks. ``dense``, ``lexical``: ``qid``, ``facet``, ``id``, ``score`` of windows; ``windows``: ``id``, ``parent``.

    Windows get competition ranks in each facet and kind; a parent has its best; its score is the mean over facets of
    1 / (60 + dense rank) + 1 / (60 + lexical rank). A ranking without the parent adds nothing.
    """
    ranked = [
        competition_ranks(s, "_f").select("qid", "facet", "id", F.lit(kind).alias("kind"), "rank")
        for kind, s in (("d", dense.withColumn("_f", F.struct("qid", "facet"))), ("l", lexical.withColumn("_f", F.struct("qid", "facet"))))
    ]
    best = ranked[0].unionByName(ranked[1]).join(windows, "id").groupBy("qid", "facet", "kind", "parent").agg(F.min("rank").alias("rank"))
    facets = dense.select("qid", "facet").union(lexical.select("qid", "facet")).distinct().groupBy("qid").agg(F.count("*").alias("_n"))
    return best.groupBy("qid", "parent").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("_s")).join(facets, "qid").select("qid", "parent", (F.col("_s") / F.col("_n")).alias("score"))


def collapse(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """Window scores to parents: the largest."""
    return scores.join(windows.select("id", "parent"), "id").groupBy("qid", "parent").agg(F.max("score").alias("score"))


def overlap_scorer(pairs: DataFrame, query: str = "query", text: str = "text") -> Column:
    """Stand-in for a neural reranker: the share of the query's different tokens that the text has."""
    q, t = F.array_distinct(tokens(F.col(query))), F.array_distinct(tokens(F.col(text)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank_with(pairs: DataFrame, predict: Callable[[list[tuple[str, str]]], list[float]], query: str = "query", text: str = "text") -> DataFrame:
    """Adds ``rerank`` by any model that scores (query, text) pairs in batches; the model is called on the workers."""

    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return pairs.withColumn("rerank", F.pandas_udf(score, "double")(F.col(query), F.col(text)))


Predict = Callable[[DataFrame, str, str], Column]
#: Windows reranked in grouped retrieval, modes that rerank twice, and the characters of a passage.
GROUP_CANDIDATES = {"speed": 20, "balanced": 30, "quality": 50}
DUAL = ("balanced", "quality")
PASSAGE, LEAD, TAIL = 512, 384, 128


def rerank_passages(pairs: DataFrame, mode: str, scorer: Predict = overlap_scorer) -> DataFrame:
    """Adds ``rerank`` to ``pairs``: ``query``, ``text`` and ``all_text`` (may be null). In two passes the better of the text's and the whole text's
    passage counts; in one a passage is the text's beginning and that of the whole text."""
    text, whole = F.coalesce("text", F.lit("")), F.coalesce("all_text", F.lit(""))
    own = F.substring(text, 1, PASSAGE)
    if mode in DUAL:
        p = pairs.withColumn("_own", own).withColumn("_whole", F.when(whole != "", F.substring(whole, 1, PASSAGE)).otherwise(own))
        return p.withColumn("rerank", F.greatest(scorer(p, "query", "_own"), scorer(p, "query", "_whole"))).drop("_own", "_whole")
    one = F.when(whole != "", F.concat(F.substring(text, 1, LEAD), F.lit("\n"), F.substring(whole, 1, TAIL))).otherwise(F.substring(text, 1, LEAD))
    p = pairs.withColumn("_one", one)
    return p.withColumn("rerank", scorer(p, "query", "_one")).drop("_one")


def dense_scores(docs: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """``docs``: ``id``, ``vec``; ``asked``: ``qid`` (int), ``vec``. The ``k`` of highest cosine: ``qid``, ``id``, ``score``, ``pos``. The queries are held by each task (see dense.exact_top_k), ids other than numbers travel as hashes and come back by a join."""
    number = dict(docs.dtypes)["id"] == "bigint"
    v = docs.select("id", "vec", F.col("id").alias("_h") if number else F.xxhash64("id").alias("_h"))
    top = exact_top_k(v.select(F.col("_h").alias("id"), "vec"), asked.select((-F.col("qid").cast("bigint") - 1).alias("qid"), "vec"), k, dim)
    return top.select((-F.col("qid") - 1).cast("int").alias("qid"), F.col("id").alias("_h"), "score", "pos").join(v.select("id", "_h"), "_h").drop("_h")


def retrieve_sessions(sessions: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], dim: int, k: int = 10, mode: str = "balanced", scorer: Predict = overlap_scorer) -> DataFrame:
    """Sessions for each query: ``qid``, ``id``, ``score``, ``pos``.

    ``sessions``: ``id``, ``text`` (what the user said), ``all_text``; ``queries``: ``qid``, ``text``; ``embed`` makes a vector of a text. Sixty nearest
    sessions; where the lead of the first is small, or three or more come within a tenth of it, a second ask with the first session's
    beginning, whose twenty answers count half; BM25 over all sessions; fusion; passages of the best are reranked and blended.
    """
    docs = sessions.select("id", "text", "all_text", embed(F.col("text")).alias("vec"))
    near = cut(dense_scores(docs, queries.select("qid", embed(F.col("text")).alias("vec")), dim, 60))
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("score")))
    lead = near.groupBy("qid").agg(at(1).alias("s1"), at(2).alias("s2"), at(5).alias("s5"), F.max_by("id", -F.col("pos")).alias("id"), F.collect_list("score").alias("_all"))
    crowd = F.size(F.filter("_all", lambda s: s >= F.col("s1") * 0.9)) >= 3
    more = lead.where(F.col("s5").isNotNull() & ((F.col("s1") - F.col("s2") < (F.col("s2") - F.col("s5")) * 2.0) | crowd)).select("qid", "id")
    asked = more.join(docs.select("id", F.substring("text", 1, 200).alias("_lead")), "id").join(queries.select("qid", "text"), "qid")
    again = dense_scores(docs, asked.select("qid", embed(F.concat_ws(" ", "text", "_lead")).alias("vec")), dim, 20).select("qid", "id", (F.col("score") * 0.5).alias("score"))
    dense = near.select("qid", "id", "score").unionByName(again).groupBy("qid", "id").agg(F.max("score").alias("score"))
    fused = cut(stage1(dense, bm25(sessions.select("id", "text"), queries)).select("qid", "id", F.round("score", 9).alias("score")))
    best = top_k(fused, CANDIDATES[mode]).drop("pos").join(docs.select("id", "text", "all_text"), "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    best = final_blend(rerank_passages(best, mode, scorer), CANDIDATES[mode]).select("qid", "id", "score", "final")
    bounds = best.groupBy("qid").agg(F.max("score").alias("_top"), F.min("final").alias("_least"))
    out = fused.join(best.select("qid", "id", "final"), ["qid", "id"], "left").join(bounds, "qid")
    below = F.when(F.col("_top") > 0, F.col("score") / F.col("_top") * F.col("_least") * 0.99).otherwise(0.0)
    return top_k(out.select("qid", "id", F.round(F.coalesce("final", below), 9).alias("score")), k)


def retrieve_grouped(windows: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], dim: int, k: int = 10, mode: str = "balanced", scorer: Predict = overlap_scorer) -> DataFrame:
    """Parents of windows for each query: ``qid``, ``parent``, ``score``, ``pos``.

    ``windows``: ``id``, ``parent``, ``text``; ``queries``: ``qid``, ``text``; ``embed`` makes a vector of a text. In each facet of a query all windows have a
    dense and a lexical competition rank; a parent has its best of each; its score is the mean over facets of 1 / (60 + dense) + 1 / (60 + lexical),
    where a facet for a name counts only if some window of the parent has the name. The best windows are reranked; a parent gets
    0.5 / (60 + its best rank there) on top.
    """
    from sediment.functions.vectors import dot, unit

    facets = cut(query_facets(queries).withColumn("vec", unit(embed(F.col("text")))).withColumn("qf", F.col("qid") * MOST_FACETS + F.col("facet")))
    w = windows.select("id", "parent", "text", unit(embed(F.coalesce("text", F.lit("")))).alias("vec"))
    n = w.count()
    # the stated queries against all windows
    sims = w.join(F.broadcast(facets.select("qf", F.col("vec").alias("_q")))).select("qf", "id", "parent", F.round(F.coalesce(F.nanvl(dot(F.col("vec"), F.col("_q")), F.lit(0.0)), F.lit(0.0)), 9).alias("score"))
    dense = competition_ranks(cut(sims), "qf").select("qf", "id", "parent", F.col("rank").alias("dr"))
    said = cut(bm25(w.select("id", "text"), facets.select(F.col("qf").alias("qid"), "text")).select(F.col("qid").alias("qf"), "id", F.round("score", 9).alias("score")).where("score > 0"))
    none = said.groupBy("qf").agg((F.count("*") + 1).cast("int").alias("_none"))  # all without a score share the next rank
    lexical = competition_ranks(said, "qf").select("qf", "id", F.col("rank").alias("lr"))
    ranks = cut(dense.join(lexical, ["qf", "id"], "left").join(F.broadcast(none), "qf", "left").withColumn("lr", F.coalesce("lr", "_none", F.lit(1))).drop("_none"))
    ranks = ranks.withColumn("qid", F.floor(F.col("qf") / MOST_FACETS).cast("int")).withColumn("facet", F.pmod("qf", F.lit(MOST_FACETS)).cast("int"))
    # parents
    names = facets.where("facet > 0").select("qf", F.lower("entity").alias("entity"))
    text = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    pattern = F.concat(F.lit(BEFORE), F.regexp_replace("entity", r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(AFTER))
    covered = w.join(F.broadcast(names)).where(F.regexp_like(text, pattern)).select("qf", "parent").distinct().withColumn("_has", F.lit(True))
    best = ranks.groupBy("qid", "qf", "facet", "parent").agg(F.min("dr").alias("dr"), F.min("lr").alias("lr")).join(covered, ["qf", "parent"], "left")
    part = 1.0 / (RRF + F.col("dr")) + 1.0 / (RRF + F.col("lr"))
    counts = (F.col("facet") == 0) | F.coalesce("_has", F.lit(False))
    parents = best.groupBy("qid", "parent").agg(F.avg(F.when(counts, part).otherwise(0.0)).alias("score"))
    # windows to rerank: of the first in any facet and kind those with the best mean
    most = min(GROUP_CANDIDATES[mode], n)
    reach = min(max(most * 2, k * 6), n)
    first = [top_k(ranks.select("qf", "id", F.col(r).alias("r"), (-F.col(r)).alias("score")), reach, by="qf").select(F.floor(F.col("qf") / MOST_FACETS).cast("int").alias("qid"), "id") for r in ("dr", "lr")]
    chosen = first[0].union(first[1]).distinct()
    stage = ranks.join(chosen, ["qid", "id"], "left_semi").groupBy("qid", "id", "parent").agg(F.round(F.avg(part), 12).alias("score"))
    chosen = top_k(stage, most).select("qid", "id", "parent").join(w.select("id", "text"), "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    crossed = competition_ranks(cut(chosen.withColumn("score", scorer(chosen, "query", "text"))), "qid").groupBy("qid", "parent").agg(F.min("rank").alias("_c"))
    out = parents.join(crossed, ["qid", "parent"], "left").withColumn("score", F.col("score") + F.coalesce(0.5 / (RRF + F.col("_c")), F.lit(0.0)))
    return top_k(out.select("qid", "parent", F.round("score", 9).alias("score")), k, tie="parent")


def recall_facts(facts: DataFrame, queries: DataFrame, now: float, k: int = 10, mode: str = "balanced", dense: DataFrame | None = None) -> DataFrame:
    """Facts for each query: BM25 over all eligible facts, fused with ``dense`` scores if given, the best reranked, blended, weighted by age,
    access and confidence. ``facts``: ``id``, ``text``, ``confidence``, ``created_at``, ``access_count``; ``queries``: ``qid``, ``text``. Returns ``qid``, ``id``, ``score``, ``pos``.
    """
    lexical = bm25(facts.select("id", "text"), queries)
    empty = lexical.select("qid", "id", F.lit(0.0).alias("score"))
    fused = cut(stage1(dense if dense is not None else empty, lexical).where("score > 0").select("qid", "id", "score"))
    best = top_k(fused, CANDIDATES[mode]).drop("pos").join(facts.select("id", "text"), "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    best = cut(final_blend(best.withColumn("rerank", overlap_scorer(best)), CANDIDATES[mode]).select("qid", "id", "score", "final"))
    # every other scored fact stays below the candidates in its order, as in final_blend, until all are weighted
    bounds = best.groupBy("qid").agg(F.max("score").alias("_top"), F.min("final").alias("_least"))
    out = fused.join(best.select("qid", "id", "final"), ["qid", "id"], "left").join(bounds, "qid").join(facts.select("id", "confidence", "created_at", "access_count"), "id")
    out = out.withColumn("final", F.coalesce("final", F.col("score") / F.col("_top") * F.col("_least") * 0.99))
    out = out.withColumn("score", F.col("final") * decay(F.lit(now) - F.col("created_at"), F.col("access_count")) * F.coalesce("confidence", F.lit(1.0)))
    return top_k(out.select("qid", "id", "score"), k)


# Cues of an explicit comparison, question words, and words that carry no topic.
COMPARISON_CUES = ("both", "common", "compare", "difference", "different", "each", "either", "same", "similar", "respectively")
QUESTION_WORDS = ("how", "what", "when", "where", "which", "who", "whom", "whose", "why")
FACET_STOPWORDS = (
    "a an and are as at be been being both by common compare did difference different do does each either for from had has have how in is it of on or respectively same similar "
    "that the their them they this to was were what when where which who whom whose why with"
).split()
#: Fixed value: facets of a query, the query itself included.
MOST_FACETS = 4


def query_mentions(text: Column) -> Column:
    """What a query names: quoted texts, capitalised words (several in a row as one) and dotted or slashed words, in the order of these kinds, repeats left out."""
    runs = F.regexp_extract_all(text, F.lit(r"\b([A-Z][\p{L}\p{N}_]+(?:\s+[A-Z][\p{L}\p{N}_]+)*)"), F.lit(1))
    runs = F.transform(runs, lambda x: F.regexp_replace(x, rf"^(?i)(?:(?:{'|'.join(FACET_STOPWORDS)})\s+)+", ""))  # a sentence's first word is no part of a name
    dotted = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_./-]+\.[\p{L}\p{N}_]+"), F.lit(0))
    quotes = F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.filter(F.concat(quotes, runs, dotted), lambda x: F.length(x) > 1))


def _first_of_each(items: Column, key) -> Column:
    """Items whose key doesn't come before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def comparison_entities(text: Column) -> Column:
    """The names in a query that compares explicitly, in their order; fewer than two are none. Question words and cues at the beginning of a name are no part of it."""
    runs = F.regexp_extract_all(text, F.lit(rf"{BEFORE}[A-Z][A-Za-z0-9'_-]*(?:\s+[A-Z][A-Za-z0-9'_-]*)*"), F.lit(0))
    begin = "|".join([*QUESTION_WORDS, *COMPARISON_CUES])
    runs = F.transform(runs, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), rf"^(?i)(?:(?:{begin})(?: |$))+", ""))
    names = _first_of_each(F.filter(runs, lambda x: x != ""), F.lower)
    compares = F.arrays_overlap(tokens(text), F.array(*map(F.lit, COMPARISON_CUES)))
    return F.when(compares & (F.size(names) >= 2), names).otherwise(F.array().cast("array<string>"))


def query_facets(queries: DataFrame, most: int = MOST_FACETS) -> DataFrame:
    """``qid``, ``facet`` (0: the query itself), ``text``, ``entity``: a query that compares two or more names is also asked for each, with the words that are left as its focus, up to ``most`` facets in all."""
    q = queries.select("qid", "text", comparison_entities(F.col("text")).alias("_m"), tokens(F.col("text")).alias("_t"))
    said = F.flatten(F.transform("_m", lambda m: tokens(m)))
    focus = F.array_join(F.filter(F.array_except("_t", said), lambda x: ~x.isin(*FACET_STOPWORDS)), " ")
    own = F.transform(F.slice("_m", 1, most - 1), lambda m: F.struct(F.trim(F.concat_ws(" ", m, focus)).alias("text"), m.alias("entity")))
    first = F.array(F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("entity")))
    each = _first_of_each(F.concat(first, F.coalesce(own, F.array().cast("array<struct<text:string,entity:string>>"))), lambda x: F.coalesce(F.lower(x["text"]), F.lit("")))
    return q.select("qid", F.posexplode(each).alias("facet", "f")).select("qid", "facet", "f.*")


def mentioned_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``qid``, ``id``: of each mention the entity whose name is it, else begins with it word by word; the more confident, more used, smaller id first."""
    m = queries.select("qid", F.explode(query_mentions(F.col("text"))).alias("_m")).select("qid", F.lower("_m").alias("key"))
    words = F.split(F.lower(F.trim("name")), " ")
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("key"), (i == F.size(words)).alias("whole"))))
    e = entities.where("trim(name) <> ''").select("id", "confidence", "access_count", begins.alias("b")).select("id", "confidence", "access_count", "b.*")
    best = F.max_by("id", F.struct("whole", "confidence", "access_count", F.negate(F.xxhash64("id"))))
    return e.join(small_side(m.distinct()), "key").groupBy("qid", "key").agg(best.alias("id")).select("qid", "id").distinct()


def walk_scores(triples: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """``starts``: ``qid``, ``id``. Open triples within ``depth`` steps of a query's entities: ``qid``, ``id``, ``score`` (confidence by depth, the best)."""
    t = triples.where("valid_until is null")
    ends = F.explode(F.array_distinct(F.array_compact(F.array("subject_id", "object_id"))))
    links = t.select(F.col("id").alias("triple_id"), F.coalesce("confidence", F.lit(1.0)).alias("c"), "subject_id", "object_id", ends.alias("u"))
    frontier = seen = starts.select("qid", F.col("id").alias("u")).distinct()
    out = None
    for d in range(1, depth + 1):
        hit = cut(links.join(frontier, "u"))
        step = hit.select("qid", F.col("triple_id").alias("id"), (F.col("c") / d).alias("score"))
        out = step if out is None else out.unionByName(step)
        if d < depth:
            other = F.when(F.col("u") == F.col("subject_id"), F.col("object_id")).otherwise(F.col("subject_id"))
            frontier = cut(hit.select("qid", other.alias("u")).where("u is not null").distinct().join(seen, ["qid", "u"], "left_anti"))
            seen = seen.unionByName(frontier)
    return out.groupBy("qid", "id").agg(F.max("score").alias("score"))


def recall(entities: DataFrame, triples: DataFrame, facts: DataFrame, queries: DataFrame, now: float, k: int = 10, mode: str = "balanced", depth: int = 2) -> DataFrame:
    """recall_facts with the graph around the entities that each query names as further evidence."""
    return recall_facts(facts, queries, now, k, mode, walk_scores(triples, mentioned_entities(queries, entities), depth))


def render(results: DataFrame) -> DataFrame:
    """``results``: ``qid``, ``pos``, ``text``, ``score``, ``valid_until``. One text for each query."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), F.col("text"), F.format_string(" (%.3f)", "score"), F.when(F.col("valid_until").isNotNull(), " [SUPERSEDED]").otherwise(""))
    return results.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
