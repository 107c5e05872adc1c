import random

from sediment.operators.references import find_broken

REFS = "rec_id string, field string, kind string, key string, created_at double, h1 int, salt string"
PARENTS = "kind string, key string, at double, named boolean, rng int, h1 string"


def run(spark, refs, parents, **kw):
    r = spark.createDataFrame([(*x, 1, "s") for x in refs], REFS)
    p = spark.createDataFrame([(*x, 1, "s") for x in parents], PARENTS)
    return sorted(tuple(x) for x in find_broken(r, p, **kw).select("rec_id", "field", "ref_status").collect())


def test_states_nulls_and_repeats(spark):
    parents = [("e", "a", 10.0, False), ("e", "a", 10.0, False), ("e", "b", None, True), ("e", "c", 5.0, False), ("e", "c", None, True), ("c", "a2", None, False), ("e", None, 1.0, False)]
    refs = [
        ("1", "f", "e", "a", 9.0), ("2", "f", "e", "a", 10.0), ("3", "f", "e", "b", 1.0), ("4", "f", "e", "c", 6.0), ("5", "f", "e", "x", 1.0), ("6", "f", "c", "a", 50.0),
        ("7", "f", "e", None, 1.0), ("8", "f", "e", "", 1.0), ("9", "f", "c", "a2", 1.0), ("1", "g", "e", "a", None), ("5", "f", "e", "x", 1.0),
    ]
    assert run(spark, refs, parents) == [("1", "f", "late"), ("3", "f", "deleted"), ("5", "f", "missing"), ("5", "f", "missing"), ("6", "f", "missing")]


def test_empty_tables(spark):
    assert run(spark, [], [("e", "a", 1.0, False)]) == []
    assert run(spark, [("1", "f", "e", "a", 1.0)], []) == [("1", "f", "missing")]


def test_hot_key_is_split(spark):
    rng = random.Random(1)
    parents = [("e", f"k{i}", float(i), False) for i in range(500)]
    refs = [(str(i), "f", "e", "k7" if rng.random() < 0.5 else f"k{rng.randrange(700)}", 300.0) for i in range(3000)]
    known = {k: at for _, k, at, _ in parents}
    want = sorted((r, "f", "missing" if k not in known else "late") for r, _, _, k, c in refs if k not in known or known[k] > c)
    assert run(spark, refs, parents, parent_rows=40, probe_rows=100) == want
