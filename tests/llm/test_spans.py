import random

import pytest

from sediment.llm import spans

SCHEMA = "id bigint, text string, h int, pos string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)


def brute(docs, length):
    where = {}
    for i, t in docs:
        for p in range(len(t or "") - length + 1):
            where.setdefault(t[p : p + length], {}).setdefault(i, []).append(p)
    cover = {}
    for by in where.values():
        if len(by) > 1:
            for i, ps in by.items():
                for p in ps:
                    cover.setdefault(i, set()).update(range(p, p + length))
    return {i: len(c) for i, c in cover.items()}


def make(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdé 🙂\n", k=k))
    shared = [text(k) for k in (39, 40, 41, 47, 60, 120)]
    docs = [(i, text(rng.randrange(0, 90)) + "".join(rng.choice(shared) + text(rng.randrange(0, 30)) for _ in range(rng.randrange(3)))) for i in range(n)]
    return docs + [(1000, docs[5][1]), (1001, None), (1002, ""), (1003, "ab" * 100), (1004, shared[5] + "x" + shared[5])]


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_against_brute_force(spark, seed):
    docs = make(seed)
    found = spans.coverage(spans.shared_spans(frame(spark, docs), length=40, shingle=20))
    got = {}
    for r in found.collect():
        got[r.id] = got.get(r.id, 0) + r.to_pos - r.from_pos
    assert got == brute(docs, 40)
    only = spans.shared_spans(frame(spark, docs), length=40, shingle=20, only_found=True)
    assert {r.id for r in only.select("id").distinct().collect()} == set(brute(docs, 40))


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choices("abcdefghij", k=2_300_000))
    piece = body[1_048_576 - 100 : 1_048_576 + 120]  # over the bound of two pieces
    got = spans.coverage(spans.shared_spans(frame(spark, [(1, body), (2, "x" * 10 + piece + "y" * 10)]))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1_048_476, 1_048_696), (2, 10, 230)]


def test_long_repeating_passages(spark):
    rng = random.Random(21)
    text = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passages = [("-" * 300, "-" * 210), ("ab" * 150, "ab" * 101 + "a"), (". " * 81, ". " * 81), ("_" * 41, "_" * 900), ("abcdefg" * 60, "cdefgab" * 50)]
    for length, shingle in ((40, 20), (41, 20)):
        for a, b in passages:
            docs = [(1, text(33) + a + text(70)), (2, text(81) + b + text(20)), (3, text(200))]
            cover = {}
            for r in spans.coverage(spans.shared_spans(frame(spark, docs), length=length, shingle=shingle)).collect():
                cover[r.id] = cover.get(r.id, 0) + r.to_pos - r.from_pos
            assert cover == brute(docs, length)
            only = spans.shared_spans(frame(spark, docs), length=length, shingle=shingle, only_found=True)
            assert {r.id for r in only.select("id").distinct().collect()} == {1, 2}


def test_empty(spark):
    assert spans.shared_spans(frame(spark, [])).count() == 0


def test_a_third_of_copies(spark):
    rng = random.Random(12)
    text = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    hot = text(500)
    docs = [(i, hot if i % 3 == 0 else text(400) if i % 3 == 1 else text(60) + hot[100:139] + text(60)) for i in range(300)]
    found = {r.id for r in spans.shared_spans(frame(spark, docs), length=40, shingle=20, only_found=True).select("id").distinct().collect()}
    assert found == set(brute(docs, 40))
    cover = {r.id: r.to_pos - r.from_pos for r in spans.coverage(spans.shared_spans(frame(spark, docs), length=40, shingle=20)).collect()}
    assert cover == brute(docs, 40) and all(cover[i] == 500 for i in range(0, 300, 3))
