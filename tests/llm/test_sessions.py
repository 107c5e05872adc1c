from sediment.llm import sessions as S

SCHEMA = "id string, timestamp double, role string, content string, session_id string, metadata string, sid string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def turn(n):
    return f'{{"turn": {n}}}'


def defects(spark, rows):
    return sorted((r.sid, r.defect) for r in S.session_defects(frame(spark, rows)).collect())


def test_defects(spark):
    rows = [
        ("1", 1.0, "user", "hi", " Ok ", None), ("2", 2.0, " BOT", "yes", "ok", None), ("3", 2.0, "system", "note", "ok", None),
        ("4", 1.0, "assistant", "hi", "open", None), ("5", 2.0, "human", "hi", "open", None),
        ("6", 9.0, "user", "hi", "turns", turn(0)), ("7", 1.0, "ai", "yes", "turns", turn(2)), ("8", 1.0, "user", " \t", "empty", None),
        ("9", 1.0, "system", "x", "empty", None), ("10", 1.0, None, "x", "role", None), ("11", 2.0, "user", "q", "role", None), ("12", 3.0, "assistant", "a", "role", None),
        ("13", 1.0, "user", "x", None, None), ("14", 1.0, "user", "x", "  ", None),
        ("15", 9000.0, "user", "x", "blank", turn(0)), ("16", 5.0, "assistant", None, "blank", turn(1)), ("17", 5.0, "assistant", "x", "blank", "{broken"),
    ]
    want = [("empty", "empty"), ("open", "no_opening"), ("open", "no_reply"), ("role", "bad_role"), ("turns", "lost_turn")]
    assert defects(spark, rows) == want
    assert defects(spark, rows + rows) == want  # rows stored twice change nothing
    assert defects(spark, []) == []


def test_ties_and_milliseconds(spark):
    rows = [("1", 1.7e12, "user", "q", "s", None), ("2", 1.7e9, "assistant", "a", "s", None)]
    assert defects(spark, rows) == []  # at one time the question comes before the answer


def test_conversations_with_clock_errors(spark):
    base = 1_700_000_000.0
    rows = [(str(i), base + 60 * i + (-3600 if i % 2 else 0), "user" if i % 2 == 0 else "assistant", f"m{i}", "s", turn(i)) for i in range(6)]
    rows += [("again", base + 2, "user", "m0", "s", turn(0))]
    got = S.conversations(frame(spark, rows)).orderBy("pos").collect()
    assert [r.content for r in got] == [f"m{i}" for i in range(6)] and [r.pos for r in got] == list(range(6))
    assert all(a.at < b.at for a, b in zip(got, got[1:], strict=False))
    clocks = S.clock_offsets(S.normal_rows(frame(spark, rows))).collect()
    assert len(clocks) == 1 and clocks[0].feasible and abs(clocks[0]["shift"] - 3600) < 61


def test_infeasible_clocks_are_rejected(spark):
    rows = [("1", 100.0, "user", "a", "s", turn(0)), ("2", 50.0, "assistant", "b", "s", turn(1)), ("3", 60.0, "user", "c", "s", turn(2)), ("4", 70.0, "assistant", "d", "s", turn(3))]
    assert not S.clock_offsets(S.normal_rows(frame(spark, rows))).first().feasible
    assert S.conversations(frame(spark, rows)).count() == 0


def test_hot_session_is_numbered_in_shards(spark):
    rows = [(f"{i:04}", float(i * 10), "user" if i % 2 == 0 else "assistant", f"m{i}", "s", None) for i in range(400)]
    got = S.conversations(frame(spark, rows), hot_rows=50, shards=7).orderBy("pos").collect()
    assert [r.content for r in got] == [f"m{i}" for i in range(400)] and [r.pos for r in got] == list(range(400))


def test_correction_changes_the_order(spark):
    base = 1_700_000_000.0
    # the service's clock is an hour behind: its unnumbered note, made between turns 2 and 3, would come before turn 0
    rows = [(str(i), base + 60 * i + (-3600 if i % 2 else 0), "user" if i % 2 == 0 else "assistant", f"m{i}", "s", turn(i)) for i in range(6)]
    rows += [("note", base + 140 - 3600, "system", "note", "s", None)]
    assert [r.content for r in S.conversations(frame(spark, rows)).orderBy("pos").collect()] == ["m0", "m1", "m2", "note", "m3", "m4", "m5"]
    assert [r.content for r in S.conversations(frame(spark, rows), hot_rows=2, shards=3).orderBy("pos").collect()] == ["m0", "m1", "m2", "note", "m3", "m4", "m5"]


def test_offset_is_the_constrained_least_squares_fit(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        base, at, off, bounds = 1.7e9 + k * 1e6, 0.0, rng.choice([-5000.0, -700.0, 900.0, 4000.0]), []
        times = []
        for i in range(rng.randrange(4, 12)):
            at += rng.randrange(1, 200)
            times.append(at + (off if i % 2 else 0))
            rows.append((f"{k}-{i}", base + times[-1], "user" if i % 2 == 0 else "bot", f"m{i}", f"s{k}", turn(i)))
        lo = [times[i] - times[i + 1] for i in range(0, len(times) - 1, 2)]
        hi = [times[i + 1] - times[i] for i in range(1, len(times) - 1, 2)]
        bounds = lo + hi
        grid = [max(lo) + (min(hi) - max(lo)) * j / 2000 for j in range(2001)]
        want[f"s{k}"] = 0.0 if max(lo) <= 0 <= min(hi) else min(grid, key=lambda s, b=bounds: sum((s - x) ** 2 for x in b))
    got = {r.sid: r["shift"] for r in S.clock_offsets(S.normal_rows(frame(spark, rows))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.2 for k in got)


def test_messages_sent_again_neither_open_nor_end(spark):
    rows = [("1", 1.0, "user", "q", "s", None), ("2", 2.0, "assistant", "a", "s", None), ("3", 4.0, "user", "q", "s", None)]
    assert defects(spark, rows) == [] and [r.id for r in S.conversations(frame(spark, rows)).orderBy("pos").collect()] == ["1", "2"]
    rows[2] = ("3", 40.0, "user", "q", "s", None)
    assert defects(spark, rows) == [("s", "no_reply")]


def test_hot_session_of_one_text(spark):
    rows = [(f"{i:04}", float(i * 3), "user" if i % 2 == 0 else "assistant", "same", "s", turn(i) if i < 200 else None) for i in range(400)]
    whole = [tuple(r) for r in S.rebuild(frame(spark, rows)).orderBy("id").collect()]
    assert whole == [tuple(r) for r in S.rebuild(frame(spark, rows), hot_rows=30, shards=9).orderBy("id").collect()]
    assert sum(r[1] is not None for r in whole) == 400
