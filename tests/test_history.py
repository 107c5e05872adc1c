import random

import pytest

from sediment.functions.keys import OPEN
from sediment.operators.history import HistoryStore, differing_leaves, merkle

SCHEMA = "k string, p string, created double, s bigint, e bigint, tag bigint, old int, new string, _r int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows):
    keys, out = {}, []
    for k, p, c, s, e, t in rows:
        if None in (k, p, s, e, t):
            continue
        keys.setdefault((k, p), {}).setdefault(s, []).append((c if c is not None else float("-inf"), e, t))
    for (k, p), by in keys.items():
        starts, cur = sorted(by), None
        for i, s in enumerate(starts):
            _, e, t = max(by[s])
            e = min(e, starts[i + 1]) if i + 1 < len(starts) else e
            if cur and cur[1] == s and cur[2] == t:
                cur[1] = e
            else:
                if cur:
                    out.append((k, p, *cur))
                cur = [s, e, t]
        out.append((k, p, *cur))
    return sorted(out)


def rows_of(store):
    return sorted(map(tuple, store.read().select("k", "p", "s", "e", "tag").collect()))


@pytest.mark.parametrize("hot_rows", [10**6, 25])
def test_snapshots_against_a_fold(spark, tmp_path, hot_rows):
    rng = random.Random(hot_rows)
    rows = []
    for k in ("a", "b", "c", "d"):
        for _ in range(120 if k == "a" else 20):
            s = rng.randrange(60 if k != "a" else 200)
            rows.append((k, "p", rng.choice([None, float(rng.randrange(100))]), s, rng.choice([OPEN, s + rng.randrange(1, 30)]), rng.randrange(2)))
    rows += rows[:10] + [(None, "p", 1.0, 1, 2, 1), ("z", "p", 1.0, None, 2, 1)]
    store = HistoryStore(spark, str(tmp_path / "h"), ["k", "p"], leaf_rows=2, hot_rows=hot_rows)
    for held in ([r for r in rows if (r[2] or 0) < 50], rows, rows, [r for r in rows if r[0] != "c"]):
        store.update(frame(spark, held))
        assert rows_of(store) == brute(held)


def test_only_changed_keys_are_appended_and_read(spark, tmp_path):
    first = [(f"k{i}", "p", 1.0, 1, OPEN, i % 3) for i in range(3000)]
    store = HistoryStore(spark, str(tmp_path / "h"), ["k", "p"], leaf_rows=4)
    store.update(frame(spark, first))
    second = first[5:] + [("k7", "p", 9.0, 5, OPEN, 9), ("new", "p", 1.0, 1, 2, 1)]
    store.update(frame(spark, second))
    appended = spark.read.parquet(f"{store.path}/versions/batch=1")
    # five keys are gone, one is new, one has a second version; nothing else was written
    assert {(r.k, r.s) for r in appended.collect()} == {(f"k{i}", None) for i in range(5)} | {("k7", 1), ("k7", 5), ("new", 1)}
    assert spark.read.parquet(f"{store.path}/differing").count() <= 7 and spark.read.parquet(f"{store.path}/changed").count() == 7
    assert rows_of(store) == brute(second)
    store.update(frame(spark, second))
    assert spark.read.parquet(f"{store.path}/versions/batch=2").count() == 0 and rows_of(store) == brute(second)


def test_tree_grows_with_the_snapshot(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), ["k", "p"], leaf_rows=1)
    store.update(frame(spark, [("a", "p", 1.0, 1, OPEN, 1)]))
    rows = [(f"k{i}", "p", 1.0, 1, OPEN, 1) for i in range(600)] + [("a", "p", 1.0, 1, OPEN, 1)]
    store.update(frame(spark, rows))
    assert [b for _, b in store.batches()] == [4, 12] and rows_of(store) == brute(rows)
    assert "a" not in {r.k for r in spark.read.parquet(f"{store.path}/versions/batch=1").collect()}


def test_empty_snapshots(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), ["k", "p"])
    store.update(frame(spark, []))
    assert rows_of(store) == []
    rows = [("a", "p", 1.0, 1, OPEN, 1)]
    store.update(frame(spark, rows))
    assert rows_of(store) == brute(rows)
    store.update(frame(spark, []))
    assert rows_of(store) == []


def test_trees_differ_exactly_where_rows_do(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", "p", 1, OPEN, rng.randrange(5)) for i in range(3000)]
    other = [(*r[:4], 7) if rng.random() < 0.01 else r for r in rows]
    make = lambda x: spark.createDataFrame(x, "k string, p string, s bigint, e bigint, tag bigint").selectExpr("*", "xxhash64(k, p) as hk")
    a, b = make(rows), make(other)
    got = {r.leaf for r in differing_leaves(merkle(a, ["k", "p"], 8), merkle(b, ["k", "p"], 8), 8).collect()}
    want = {r.leaf for r in a.join(b, ["k", "p"]).where(a.tag != b.tag).select(((a.hk.bitwiseAND(-1 << 56)) / (1 << 56)).cast("bigint").alias("leaf")).collect()}
    assert got == {x % 256 for x in want}
