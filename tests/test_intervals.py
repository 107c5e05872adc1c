import random

import pytest

from sediment.functions.keys import OPEN
from sediment.operators.intervals import merge_periods, periods_and_gaps

SCHEMA = "k string, s bigint, e bigint, shared boolean, tag bigint, shard string, _n int"


def rows_of(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(k, s, e, sh, t, "x", 1) for k, s, e, sh, t in rows], SCHEMA)


def brute(rows, same=False):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        cur = None
        for _, s, e, sh, t in sorted((r for r in rows if r[0] == k and r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2])):
            if cur and s <= cur[1] and (not same or t == cur[3]):
                cur = [cur[0], max(cur[1], e), cur[2] or sh or s < cur[1], cur[3]]
            else:
                if cur:
                    out.append((k, *cur[:3], s))
                cur = [s, e, sh, t]
        if cur:
            out.append((k, *cur[:3], None))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_against_a_sweep(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = []
    for k in ("a", "b", "c"):
        for _ in range(150 if k == "a" else 15):
            s = rng.randrange(4000)
            rows.append((k, s, rng.choice([s + rng.randrange(1, 12), s + rng.randrange(1, 900) if rng.random() < 0.1 else s + 3, OPEN if rng.random() < 0.01 else s + 1]), False, 0))
    got = merge_periods(rows_of(spark, rows), ["k"], hot_rows=hot_rows, shards=8).select("k", "s", "e", "shared", "next_s").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_long_cover_and_ties(spark, hot_rows):
    rows = [("a", i * 10, i * 10 + 4, False, 0) for i in range(100)] + [("a", 205, 700, False, 0), ("a", 0, 4, False, 0), ("a", 0, 4, False, 0)]
    got = merge_periods(rows_of(spark, rows), ["k"], hot_rows=hot_rows, shards=8).select("k", "s", "e", "shared", "next_s").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_tags_keep_touching_periods_apart(spark, hot_rows):
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(120):
        n = rng.randrange(1, 9)
        rows.append(("a", at, at + n, False, rng.randrange(2)))
        at += n + rng.choice([0, 0, 0, 5])
    got = merge_periods(rows_of(spark, rows), ["k"], same=True, hot_rows=hot_rows, shards=8).select("k", "s", "e", "shared", "next_s").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, same=True)


def test_nulls_empty_and_gaps(spark):
    rows = [(None, 1, 2, False, 0), ("a", None, 2, False, 0), ("a", 1, None, False, 0), ("a", 1, 3, False, 0), ("a", 3, 5, False, 0), ("a", 8, OPEN, False, 0)]
    out = periods_and_gaps(merge_periods(rows_of(spark, rows), ["k"]), ["k"]).select("kind", "from_s", "until_s", "shared").collect()
    assert sorted(map(tuple, out), key=str) == sorted([("period", 1, 5, False), ("gap", 5, 8, None), ("period", 8, OPEN, False)], key=str)
    assert merge_periods(rows_of(spark, []), ["k"]).count() == 0
