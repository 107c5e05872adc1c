import json

import pytest
from pyspark.sql import functions as F

from sediment.operators import dense, graph, search, spectral

TRIPLE = "id string, subject_id string, predicate string, object_id string, object_value string, relation_type string, confidence double, valid_until double, access_count bigint, last_accessed double"


def test_expressions(spark):
    df = spark.createDataFrame([(1, "The rollback steps, please"), (2, "steps rollback"), (3, None), (4, "ledger of currency")], "id int, c string")
    hit = lambda x: [r.id for r in df.where(search.matches(F.col("c"), x)).orderBy("id").collect()]
    assert hit('"rollback steps"') == [1] and hit("rollback steps") == [1, 2] and hit("steps AND NOT please OR ledger") == [2, 4] and hit("(ledger OR please) AND NOT currency") == [1]
    for bad in ("(a", "a)", "AND", "NOT", ""):
        with pytest.raises(ValueError):
            search.matches(F.col("c"), bad if bad != "AND" else "a AND")


def test_find_entities(spark):
    e = spark.createDataFrame([("1", "Ada Byron", 0.5, 1), ("2", "ADA", 0.1, 0), ("3", "ada x", 0.9, 0), ("4", "a%", 1.0, 0), ("5", None, 1.0, 0)], "id string, name string, confidence double, access_count int")
    assert [r.id for r in search.find_entities(e, " ada").collect()] == ["2", "3", "1"]
    assert [r.id for r in search.find_entities(e, "a%").collect()] == ["4"] and [r.id for r in search.find_entities(e, "ADA", exact=True).collect()] == ["2"]


def test_session_documents(spark):
    m = spark.createDataFrame([("s", 2.0, "b", "user", "two"), ("s", 1.0, "a", "assistant", "one"), ("t", 1.0, "c", "assistant", "x"), ("u", 1.0, "d", "user", " "), (None, 1.0, "e", "user", "y")], "session_id string, timestamp double, id string, role string, content string")
    assert [tuple(r) for r in search.session_documents(m).collect()] == [("s", "two", "one\ntwo")]


def test_merge_scopes(spark):
    r = spark.createDataFrame([("global", 1, 1, "Same  text"), ("project", 1, 1, "same text"), ("project", 1, 2, "b" * 10), ("global", 1, 2, "c" * 50)], "scope string, qid int, pos int, text string")
    got = search.merge_scopes(r, ("project", "global"), most_chars=30).collect()
    assert sorted((x.scope, x.text) for x in got) == [("project", "b" * 10), ("project", "same text")]


def test_pairs_and_scope_id(spark):
    e = spark.createDataFrame([("s", 1, "open"), ("s", 2, "open"), ("s", 3, "close"), ("t", 1, "close"), ("t", 2, "other")], "k string, t int, kind string")
    assert sorted(map(tuple, search.pair_events(e, "k", "t", "kind", "open", "close").collect())) == [("s", 1, 1, 3), ("s", 2, 2, None)]
    ids = spark.createDataFrame([("/home/My Repo!/",), ("/x/my-repo",)], "p string").select(search.scope_id(F.col("p")).alias("i")).collect()
    assert ids[0].i.startswith("my-repo-") and len(ids[0].i) == 8 + 16 and ids[0].i != ids[1].i


def test_read_sessions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"session_id": "s", "turns": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes", "timestamp": 5.0}]}]))
    got = search.read_sessions(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.content, r.timestamp, r.metadata) for r in got] == [("hi", 0.0, '{"turn":0}'), ("yes", 5.0, '{"turn":1}')]


def test_delete_and_touch(spark):
    e = spark.createDataFrame([("a", 0, None), ("b", 0, None), ("c", 1, 2.0)], "id string, access_count bigint, last_accessed double")
    t = spark.createDataFrame([("1", "a", "p", "b", None, "fact", 1.0, None, 0, None), ("2", "a", "p", "a", None, "fact", 1.0, None, 0, None), ("3", "c", "p", None, "v", "fact", 1.0, None, 0, None)], TRIPLE)
    e2, t2 = graph.touch(e, t, spark.createDataFrame([("1",), ("2",), ("2",)], "id string"), 9.0)
    assert {r.id: (r.access_count, r.last_accessed) for r in e2.collect()} == {"a": (1, 9.0), "b": (1, 9.0), "c": (1, 2.0)}
    assert {r.id: r.access_count for r in t2.collect()} == {"1": 1, "2": 1, "3": 0}
    e3, t3 = graph.delete_entities(e, t, spark.createDataFrame([("b",)], "id string"))
    assert {r.id for r in e3.collect()} == {"a", "c"} and {r.id for r in t3.collect()} == {"2", "3"}


def test_local_gap(spark):
    t = spark.createDataFrame([(str(i), f"n{i}", "p", f"n{i + 1}", None, "fact", 1.0, None, 0, None) for i in range(20)], TRIPLE)
    start = spark.createDataFrame([("n0",)], "id string")
    assert spectral.local_gap(t, start, 1) == (1.0, 1)
    wide, narrow = spectral.local_gap(t, start, 8)[0], spectral.local_gap(t, start, 3)[0]
    assert 0 < wide < narrow < 2


def test_multi_probe_keeps_the_first_answers(spark):
    v = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(40)], "id bigint, vec array<float>")
    q = v.where("id = 3").withColumnRenamed("id", "qid")
    base = [r.id for r in dense.exact_top_k(v, q, 5, 3).orderBy("pos").collect()]
    assert [r.id for r in dense.multi_probe(v, q, 5, 3).orderBy("pos").collect()][:1] == base[:1]
