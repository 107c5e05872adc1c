import pytest
from pyspark.sql import functions as F

from sediment.api import MESSAGES, Memory
from sediment.operators import retrieval
from sediment.sources.store import Store, backup


def test_life_of_a_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "db"))
    first = [("1", 1.0, "user", "Ada Byron uses Rust. Ada Byron is engineer", "s", None), ("2", 2.0, "user", "  ", "s", None)]
    m.remember(spark.createDataFrame(first, MESSAGES))
    m.remember(spark.createDataFrame([("3", 3.0, "user", "Ada Byron is director", "s", None), ("1", 1.0, "user", "again", "s", None)], MESSAGES))
    assert m.messages.count() == 2
    versions = {(r.object_value, r.valid_until) for r in m.history("ada byron", "is").collect()}
    assert versions == {("engineer", 3.0), ("director", None)}
    q = spark.createDataFrame([(1, "what is Ada Byron director of")], "qid int, text string")
    top = m.recall(q, now=10.0).orderBy("pos").collect()
    assert "director" in top[0].text and top[0].source.endswith("director")
    assert "engineer" in {r.text.split()[-1] for r in m.recall(q, now=10.0, as_of=2.0).collect()}
    m.touch(m.recall(q, now=10.0).limit(1), 11.0)
    assert m.entities.agg(F.sum("access_count")).first()[0] >= 1
    assert m.compress(200).first().n_lines >= 1 and m.check().where("n > 0").count() == 0
    assert m.retain(str(tmp_path / "arch"), before=2.5, apply=True).count() == 1
    assert m.messages.count() == 1
    m.restore(str(tmp_path / "arch"))
    assert m.messages.count() == 2 and m.usage().first().n_messages == 2
    m.cleanup("purge_expired")
    assert m.triples.where("valid_until is not null").count() == 0
    m.cleanup("delete_entity", name="ADA BYRON")
    assert m.history("ada byron").count() == 0
    made = backup(m.store, Store(spark, str(tmp_path / "copy"), "b"))
    assert made["messages"] == 1 and Store(spark, str(tmp_path / "copy"), "b").read("messages").count() == 2


def test_scopes_are_apart(spark, tmp_path):
    a, b = Memory(spark, str(tmp_path / "db"), "one"), Memory(spark, str(tmp_path / "db"), "two")
    a.remember(spark.createDataFrame([("1", 1.0, "user", "Ada uses Rust", "s", None)], MESSAGES))
    assert a.messages.count() == 1 and b.messages.count() == 0


def test_facets(spark):
    q = spark.createDataFrame([(1, "Compare Ada Byron with Grace Hopper on compilers"), (2, "who is Ada Byron"), (3, None)], "qid int, text string")
    got = {(r.qid, r.facet): r.text for r in retrieval.query_facets(q).collect()}
    assert got[1, 1] == "Ada Byron compilers" and got[1, 2] == "Grace Hopper compilers" and (2, 1) not in got and (3, 0) in got


def test_grouped_sessions(spark):
    s = "qid int, facet int, id string, score double"
    d = spark.createDataFrame([(1, 0, "a1", 3.0), (1, 0, "b1", 2.0), (1, 0, "a2", 1.0)], s)
    l = spark.createDataFrame([(1, 0, "b1", 5.0)], s)  # noqa: E741
    w = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "id string, parent string")
    got = {r.parent: r.score for r in retrieval.grouped_sessions(d, l, w).collect()}
    assert abs(got["a"] - 1 / 61) < 1e-12 and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12


def test_late_facts_go_to_quarantine(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "db"))
    m.remember(spark.createDataFrame([("1", 10.0, "user", "Ada is director", "s", None)], MESSAGES))
    m.remember(spark.createDataFrame([("2", 5.0, "user", "Ada is clerk", "s", None)], MESSAGES))
    assert m.quarantine.count() + m.triples.count() == 2


def test_a_damaged_archive_is_refused(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "db"))
    m.remember(spark.createDataFrame([("1", 10.0, "user", "Ada uses Rust", "s", None)], MESSAGES))
    m.retain(str(tmp_path / "arch"), before=99.0, apply=True)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "arch"))
    with pytest.raises(ValueError):
        m.restore(str(tmp_path / "arch"))
    assert m.messages.count() == 0
