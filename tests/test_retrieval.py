from pyspark.sql import functions as F

from sediment.functions import text as X
from sediment.operators import retrieval as R


def facets(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    out = {}
    for r in R.query_facets(q).orderBy("qid", "facet").collect():
        out.setdefault(r.qid, []).append((r.text, r.entity))
    return [out[i] for i in range(len(texts))]


def test_facets_of_comparisons(spark):
    both, one, many, twice = facets(
        spark, "How do Ada and Bruno each relax after work?", "What does Ada like?", "What do Ada, Bruno, Cleo, Dora and Emil have in common about boats?", "Do Ada and ada and Bruno differ in the same way?"
    )
    assert [t for t, _ in both] == ["How do Ada and Bruno each relax after work?", "Ada relax after work", "Bruno relax after work"] and [e for _, e in both] == [None, "Ada", "Bruno"]
    assert len(one) == 1 and [t for t, _ in many][1:] == ["Ada about boats", "Bruno about boats", "Cleo about boats"]
    assert [e for _, e in twice][1:] in (["Do Ada", "Bruno"], ["Ada", "Bruno"])


def test_competition_ranks_against_a_sort(spark):
    import random

    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, float("nan"), float(rng.randrange(9)), rng.random() * 1e6])) for g in ("a", "b") for i in range(400)] + [("c", 1, None), ("d", 1, 2.0), ("d", 2, 2.0)]
    got = {(r.g, r.i): r["rank"] for r in R.competition_ranks(spark.createDataFrame(rows, "g string, i int, score double"), "g").collect()}
    value = {(g, i): s if s is not None and s == s else float("-inf") for g, i, s in rows}
    for (g, i), s in value.items():
        assert got[g, i] == 1 + sum(x > s for (h, _), x in value.items() if h == g)


def test_passages(spark):
    p = spark.createDataFrame([(1, "alpha beta", "x " * 300 + "alpha", "alpha " + "y " * 300), (2, "alpha", None, None), (3, "beta", "z " * 180 + "gamma", "beta")], "i int, query string, text string, all_text string")
    dual = {r.i: r.rerank for r in R.rerank_passages(p, "balanced").collect()}
    single = {r.i: r.rerank for r in R.rerank_passages(p, "speed").collect()}
    assert dual == {1: 0.5, 2: 0.0, 3: 1.0} and single == {1: 0.5, 2: 0.0, 3: 1.0}


def words(vocabulary):
    return lambda c: F.transform(F.array(*map(F.lit, vocabulary)), lambda w: F.size(F.filter(X.tokens(F.coalesce(c, F.lit(""))), lambda t: t == w)).cast("float"))


def test_only_a_parent_with_both_names_counts_for_both(spark):
    rows = [("a1", "a", "Ada walks after work"), ("a2", "a", "Bruno swims after work"), ("b1", "b", "someone relaxes after work"), ("c1", "c", "Ada relaxes"), ("d1", "d", None), ("d2", "d", "")]
    w = spark.createDataFrame(rows, "id string, parent string, text string")
    q = spark.createDataFrame([(1, "How do Ada and Bruno each relax after work?")], "qid int, text string")
    got = [r.parent for r in R.retrieve_grouped(w, q, words(["ada", "bruno", "relax", "after", "work"]), 5, k=4).orderBy("pos").collect()]
    assert got[0] == "a" and set(got) == {"a", "b", "c", "d"}


def test_sessions_need_no_second_ask_when_few(spark):
    s = spark.createDataFrame([("s1", "boats and sails", "boats and sails\nyes"), ("s2", "trains", "trains"), ("s3", "", "")], "id string, text string, all_text string")
    q = spark.createDataFrame([(1, "sails on boats")], "qid int, text string")
    got = R.retrieve_sessions(s, q, words(["boats", "sails", "trains"]), 3).orderBy("pos").collect()
    assert got[0].id == "s1" and got[0].score > 0.5


def test_durable_candidates(spark):
    rows = [
        ("user", "From now on call me Ada"), ("human", "remember that I like tea"), ("user", "we decided to wait"), ("user", "our stack is small"), ("user", "passwd=hunter2, always"), ("bot", "Fixed the root cause"),
        ("assistant", "```\nfixed\n```"), ("assistant", "nothing here"), ("user", "hallways"), (None, "always"), ("user", None),
    ]
    df = spark.createDataFrame(rows, "role string, content string").select(X.durable_candidate(F.col("role"), F.col("content")).alias("c"), X.durable_excerpt(F.col("content")).alias("e"))
    got = [r.c and r.c.kind for r in df.collect()]
    assert got == ["user_preference", "user_preference", "project_fact", "project_fact", None, "work_outcome", None, None, None, None, None]
    text = "# Title\r\n\n  ## Part \nhttps://x.y\n```py\ncode\n```\nlast"
    assert spark.createDataFrame([(text,)], "t string").select(X.durable_excerpt(F.col("t"))).first()[0] == "Title\nPart\nlast"


def test_windows_of_a_place(spark):
    df = spark.range(0, 30).selectExpr("cast(id as int) as n").withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))))).where("i < n")
    for r in df.select("n", "i", X.windows_of(F.col("i"), F.col("n")).alias("w"), X.window_starts(F.col("n")).alias("s")).collect():
        assert sorted(r.w) == sorted(s for s in r.s if s <= r.i < s + 4), (r.n, r.i)
