import random

import pytest

from sediment.llm.mixing import count_tokens, mix, sainte_lague, seats_of, shares

TARGETS = "source_name string, target_share double, max_repeats int"


def test_sainte_lague():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7, dict.fromkeys("abc", 99)) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague({"a": 1.0, "b": 1.0}, 10, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert sainte_lague({"a": 0.0, "b": 1.0}, 3, {"a": 9, "b": 2}) == {"a": 0, "b": 2}


def sized(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "id bigint, source string, n_tokens bigint, times int, shard string")


@pytest.mark.parametrize("shard_tokens", [10**9, 5000])
def test_shares_are_met(spark, shard_tokens):
    rows = [(i, ["Big ", "mid", "small"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], 50 + i * 7 % 101) for i in range(3000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("MID", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, 1), (None, 0.1, 1)], TARGETS)
    m = mix(sized(spark, rows), targets, shard_tokens=shard_tokens)
    report = {r.source: r for r in shares(m, targets).collect() if r.source and r.target_share}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in report.values())
    assert report["small"].max_times == 3 and report["big"].max_times == 1
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mix(sized(spark, rows), targets, shard_tokens=shard_tokens).collect()))


def test_dirty_and_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    rows = [(1, "a", 10), (2, None, 10), (3, "b", 10), (4, "a", 0), (5, "a", None)]
    assert {(r.id, r.times) for r in mix(sized(spark, rows), targets).collect()} == {(1, 2)}
    assert mix(sized(spark, []), targets).count() == 0 and mix(sized(spark, rows), targets.limit(0)).count() == 0
    assert shares(mix(sized(spark, []), targets), targets).first().actual_share == 0.0


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "a" * 50_000, 5)], "id bigint, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in count_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000


def naive(weights, seats, capacity):
    """The next seat to the highest quotient, one by one."""
    got = [0] * len(weights)
    for _ in range(seats):
        best = [(w / (2 * g + 1), -i) for i, (w, g, c) in enumerate(zip(weights, got, capacity, strict=True)) if g < c and w > 0]
        if not best:
            break
        got[-max(best)[1]] += 1
    return got


def test_seats_against_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 12)
        w = [rng.choice([0.0, 1.0, rng.random(), rng.randrange(1, 10**6)]) for _ in range(n)]
        cap = [rng.randrange(60) for _ in range(n)]
        seats = rng.randrange(300)
        assert seats_of(w, seats, cap).tolist() == naive(w, seats, cap)
    assert seats_of([], 5, []).tolist() == []


@pytest.mark.parametrize("shard_tokens", [10**9, 1000, 100])
def test_shards_may_outnumber_blocks(spark, shard_tokens):
    rows = [(i, "a" if i < 2000 else "b", 10) for i in range(2500)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)
    m = mix(sized(spark, rows), targets, blocks=50, shard_tokens=shard_tokens)
    report = {r.source: r for r in shares(m, targets).collect()}
    # the scarce source gives all it has three times, the other as many tokens once
    assert 14_850 <= report["b"].n_tokens <= 15_000 and abs(report["a"].n_tokens - 15_000) <= 500
    assert report["a"].max_times == 1 and report["b"].max_times == 3
    assert all(abs(r.actual_share - 0.5) < 0.01 for r in report.values())


def test_report_against_plain_sums(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", " A", "b", "c"]), rng.randrange(1, 400)) for i in range(4000)]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.3, 2)], TARGETS)
    m = mix(sized(spark, rows), targets, shard_tokens=20_000)
    used = {r.id: r.times for r in m.collect()}
    size = {"a": 0, "b": 0, "c": 0}
    for i, s, n in rows:
        size[s.strip().lower()] += n * used.get(i, 0)
    room = {"a": 1, "b": 4, "c": 2}
    have = {k: room[k] * sum(n for _, s, n in rows if s.strip().lower() == k) for k in room}
    whole = min(have["a"] / 0.2, have["b"] / 0.5, have["c"] / 0.3)
    for r in shares(m, targets).collect():
        assert r.n_tokens == size[r.source] and abs(r.n_tokens - r.target_share * whole) < 0.01 * whole
        assert abs(r.actual_share - r.target_share) < 0.01 and r.max_times <= room[r.source]
