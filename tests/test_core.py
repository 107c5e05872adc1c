import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.functions import text as X
from sediment.functions.strings import deletions, near, within_one_edit
from sediment.operators import compression, consolidation, dense, evaluation, graph, ingest, retrieval, spectral, temporal
from sediment.operators.components import components
from sediment.operators.lexical import bm25, bm25_many, top_k
from sediment.plans import texts
from sediment.sources import archive, store

TRIPLE = "id string, subject_id string, predicate string, object_id string, object_value string, relation_type string, confidence double, valid_from double, valid_until double, source_ref string, created_at double, access_count bigint"


def triple(i, s, o=None, v=None, p="p", rel="fact", c=1.0, vf=0.0, vu=None, src=None, at=0.0):
    return (i, s, p, o, v if o is None and v is not None else (None if o else ""), rel, c, vf, vu, src, at, 0)


def test_windows(spark):
    rows = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in (0, 1, 4, 5, 7)], "n int, l array<string>")
    got = {r.n: [w.start for w in r.w] for r in rows.select("n", X.windows(F.col("l")).alias("w")).collect()}
    assert got == {0: [], 1: [0], 4: [0], 5: [0, 1], 7: [0, 2, 3]}


def test_text_functions(spark):
    df = spark.createDataFrame([("Ada Byron uses Éaux_9. She moved to Kent! \"so it is\"",), (None,), ("",)], "c string")
    r = df.select(X.tokens("c").alias("t"), X.token_estimate(F.col("c")).alias("n"), X.facts(F.col("c")).alias("f"), X.proper_names(F.col("c")).alias("p"), X.quoted(F.col("c")).alias("q")).collect()
    assert r[0].t[3] == "éaux_9" and r[0].n == 11 and r[0].q == ["so it is"] and "Ada Byron" in r[0].p
    assert any(f.predicate == "moved_to" for f in r[0].f)
    assert r[1].n == 0 and r[2].n == 0 and r[2].t == []


def test_confident_facts_among_many_equal_ones(spark):
    rows = [(f"f{i:03}", "Ada uses ledger", 0.01 if i < 90 else 1.0, 0.0, 0) for i in range(110)] + [(f"g{i:03}", "Bob has boat", 1.0, 0.0, 0) for i in range(200)]
    facts = spark.createDataFrame(rows, "id string, text string, confidence double, created_at double, access_count bigint")
    r = retrieval.recall_facts(facts, spark.createDataFrame([(1, "who uses ledger")], "qid int, text string"), 100.0).orderBy("pos").collect()
    assert [x.id for x in r] == [f"f{i:03}" for i in range(90, 100)] and [x.pos for x in r] == list(range(1, 11))


ACCENTED = [
    "Ada Byron uses Zoë_9 daily — Kent",
    "José moved to Łódź. Élan Vital and CaféNord, MÉlan",
    "René Descartes\u00a0Quill prefers größere Städte",
    "naïve Bob\u2003Stone is Über klug; Émile has 3½ Äpfel",
    "Plain Text was Here",
    "Caf\u0301 Cafe\u0301 uses Tea, Garc\u00eda Marquez switched to Kraków",
    None,
    "",
]
PY_NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
PY_FACT = r"\b(\w+(?:\s+\w+)?)\s+(uses?|is|was|has|prefers?|decided|switched to|moved to)\s+(\w+(?:\s+\w+)?)\b"


def test_texts_with_accents_against_python(spark, tmp_path):
    rows = [(f"m{i}", float(i), "user", "s", c, "{}") for i, c in enumerate(ACCENTED)]
    spark.createDataFrame(rows, "id string, timestamp double, role string, session_id string, content string, metadata string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([("e0", "Ada Byron", "person", 0.0, 1.0, 0, 0.0)], "id string, name string, entity_type string, created_at double, confidence double, access_count bigint, last_accessed double").write.parquet(str(tmp_path / "entities.parquet"))
    names = [list(dict.fromkeys(m for m in re.findall(PY_NAME, c or "") if len(m) > 2)) for c in ACCENTED]
    found = [(s, p.lower().replace(" ", "_"), o) for c in ACCENTED for s, p, o in re.findall(PY_FACT, c or "", re.I)]
    d = str(tmp_path)
    assert {r.name: r.n_messages for r in texts.extract_names(spark, d).collect()} == Counter(n for l in names for n in l)
    assert {(r.subject, r.predicate, r.object): r.n for r in texts.extract_facts(spark, d).collect()} == Counter(found)
    assert {(r.subject_key, r.predicate, r.value) for r in texts.ingest_assertions(spark, d).collect()} == {(s.lower(), p, o.lower()) for s, p, o in found}
    assert {r.name_key for r in texts.resolve_entities(spark, d).collect()} == {n.lower() for l in names for n in l}
    pairs = Counter((min(a, b), max(a, b)) for l in names for i, a in enumerate(l) for b in l[i + 1 : i + 5])
    assert {(r.a, r.b): r.n for r in texts.cooccurrence_pairs(spark, d).collect()} == pairs


def test_superseding_one_key_with_many_assertions(spark):
    rng = random.Random(8)
    rows = [("k", "p", i, rng.choice("abc"), float(i), rng.random() < 0.6) for i in range(6000)]
    df = temporal.supersede(spark.createDataFrame(rows, "key string, predicate string, seq int, value string, valid_from double, replaces boolean"), ["key", "predicate"])
    got, open_, want = {r.seq: r.valid_until for r in df.collect()}, [], {}
    for r in rows:
        if r[5]:
            want |= {o[2]: r[4] for o in open_ if o[3] != r[3]}
            open_ = [o for o in open_ if o[3] == r[3]]
        open_.append(r)
    assert got == {r[2]: want.get(r[2]) for r in rows}
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # such a frame takes the square of a key's rows


def test_facts_are_found_between_any_blanks(spark):
    said = ["Ada\u2003uses\u2003tea", "Ada\x0buses\x85tea", "Ada uses", "uses tea", "reuses old tea", "he SWITCHED TO tea", "", None]
    got = [None if r.f is None else [tuple(x) for x in r.f] for r in spark.createDataFrame(list(enumerate(said)), "i int, c string").orderBy("i").select(X.facts(F.col("c")).alias("f")).collect()]
    one = ("Ada", "uses", "tea")
    assert got == [[one], [one], [], [], [], [("he", "switched_to", "tea")], [], None]


def test_edit_distance(spark):
    pairs = [("abcd", "abcd"), ("abcd", "abed"), ("abcd", "acbd"), ("abcd", "abc"), ("abcd", "abxcd"), ("abcd", "axxd"), ("abcd", "badc"), ("", "a")]
    for a, b in pairs:
        assert within_one_edit(a, b) == within_one_edit(b, a)
    assert [within_one_edit(a, b) for a, b in pairs] == [True, True, True, True, True, False, False, True]
    df = spark.createDataFrame(pairs, "a string, b string").where("a <> '' and b <> ''")
    shared = df.withColumn("n", near(F.col("a"), F.col("b")) & F.arrays_overlap(deletions(F.col("a")), deletions(F.col("b"))))
    assert {(r.a, r.b) for r in shared.where("n").collect()} == {p for p in pairs[:5]}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, *edges[:5], (7, 7)], "a bigint, b bigint").unionByName(spark.createDataFrame([(None, 1)], "a bigint, b bigint"))
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_bm25_against_formula(spark):
    docs = [(1, "a b c a"), (2, "b c"), (3, None), (4, "c d e")]
    got = {(r.qid, r.id): r.score for r in bm25(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame([(1, "a c c"), (2, "zz"), (3, None)], "qid int, text string")).collect()}
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: np.log(n - d + 0.5) - np.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    want = {}
    for i, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("a", "c", "c") if w in t)
        if set(t) & {"a", "c"}:
            want[1, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert bm25(spark.createDataFrame([], "id int, text string"), spark.createDataFrame([(1, "a")], "qid int, text string")).count() == 0


def test_many_queries_as_one_matrix(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijklm", k=rng.randrange(0, 30)))) for i in range(300)] + [(900, None)], "id bigint, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijklmz", k=12))) for i in range(20)] + [(90, None), (91, "zz")], "qid int, text string")
    for cells in (10**6, 40):
        many = {(r.qid, r.pos): (r.id, round(r.score, 6)) for r in bm25_many(docs, queries, 5, most_cells=cells).collect()}
        plain = {(r.qid, r.pos): (r.id, round(r.score, 6)) for r in top_k(bm25(docs, queries).withColumn("score", F.round("score", 9)), 5).collect()}
        assert many == plain and len(many) == 100
    assert bm25_many(docs.limit(0), queries, 5).count() == 0 and bm25_many(docs, queries.limit(0), 5).count() == 0


def test_top_k_ties(spark):
    s = spark.createDataFrame([(1, i, 1.0) for i in (5, 3, 4)], "qid int, id int, score double")
    assert [r.id for r in top_k(s, 2).orderBy("pos").collect()] == [3, 4]


def test_exact_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>")
    got = dense.exact_top_k(df, df.where("id % 50 = 0").withColumnRenamed("id", "qid"), 5, 8, block=2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        s = u @ u[q]
        s[q] = -2
        assert [r.id for r in got.where(f"qid = {q}").orderBy("pos").collect()] == list(np.argsort(-s)[:5])


def fold(rows):
    """Sequential supersession."""
    out, open_, rejected = {}, [], set()
    for seq, v, t, rep in rows:
        clash = [r for r in open_ if rep and r[1] != v]
        if any(r[2] > t for r in clash):
            rejected.add(seq)
            continue
        for r in clash:
            out[r[0]] = t
        open_ = [r for r in open_ if r not in clash] + [(seq, v, t)]
    return {s: out.get(s) for s, *_ in rows}, rejected


def test_supersession_against_fold(spark):
    rng = random.Random(11)
    rows, want, bad = [], {}, {}
    for k in range(40):
        t, mine = 0.0, []
        for i in range(rng.randrange(1, 9)):
            t = t + rng.randrange(3) if k % 3 else float(rng.randrange(10))
            mine.append((i, rng.choice("xyz"), t, rng.random() < 0.7))
        rows += [(str(k), *m) for m in mine]
        f, rej = fold(mine)
        want |= {(str(k), s): v for s, v in f.items()}
        bad |= {(str(k), s): s in rej for s in f}
    df = spark.createDataFrame(rows, "k string, seq int, value string, valid_from double, replaces boolean")
    got = temporal.supersede_any(df, ["k"]).collect()
    nan = lambda v: None if v is None or v != v else v
    assert {(r.k, r.seq): r.rejected for r in got} == bad
    assert {(r.k, r.seq): nan(r.valid_until) for r in got if not r.rejected} == {k: v for k, v in want.items() if not bad[k]}


def test_as_of_is_half_open(spark):
    df = spark.createDataFrame([triple("1", "a", v="x", vf=0.0, vu=10.0), triple("2", "a", v="", vf=10.0), triple("3", "a", v="z", vf=None)], TRIPLE)
    assert [r.id for r in temporal.as_of(df, 10.0).collect()] == ["2"]
    assert [r.id for r in temporal.as_of(df, 0.0).collect()] == ["1"]


def test_graph_walk_and_degrees(spark):
    e = spark.createDataFrame([(x, x.upper(), 0.0) for x in "abcdz"], "id string, name string, created_at double")
    t = spark.createDataFrame([triple("1", "a", "b"), triple("2", "b", "c"), triple("3", "c", "d"), triple("4", "a", "a"), triple("5", "d", v="x")], TRIPLE)
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.triple_id: r.depth for r in graph.neighbourhood(t, start, 3).collect()} == {"1": 1, "4": 1, "2": 2, "3": 3}
    assert {r.id: r.degree for r in graph.degrees(e, t).collect()} == {"a": 2, "b": 2, "c": 2, "d": 2, "z": 0}
    assert [r.id for r in graph.orphans(e, t).collect()] == ["z"]


def test_prefix_duplicates(spark):
    e = spark.createDataFrame([("1", "Ada"), ("2", "ada"), ("3", "Ada Byron"), ("4", "Adam"), ("5", None), ("6", "50% off")], "id string, name string")
    assert {(r.key_a, r.key_b) for r in graph.prefix_duplicates(e).collect()} == {("ada", "ada"), ("ada", "ada byron")}


def test_spectral_properties(spark):
    five = [(f"{g}{i}-{g}{j}", f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)]
    t = spark.createDataFrame([triple(*r) for r in five] + [triple("bridge", "x0", "y0", c=0.1)], TRIPLE)
    adj = spectral.adjacency(t)
    own = {r.id: r.cluster for r in spectral.clusters(adj).collect()}
    assert len(own) == 10 and len({own[f"x{i}"] for i in range(5)}) == 1 and own["x1"] != own["y1"]
    gap = spectral.spectral_gap(adj)
    assert 0 < gap < 0.3 and abs(spectral.spectral_gap(adj, local_links=0, tolerance=1e-2) - gap) < 1e-3
    loop = spectral.adjacency(spark.createDataFrame([triple("1", "a", "a", rel="causal")], TRIPLE)).collect()
    assert [tuple(r) for r in loop] == [("a", "a", 3.0)]
    assert spark.range(1).select(spectral.radius(F.lit(0.0)), spectral.radius(F.lit(0.05)), spectral.radius(F.lit(1.5))).first() == (10, 15, 2)


def test_eigenvalues_against_a_dense_solve(spark):
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a != b} | {(i, i + 1) for i in range(59)} | {(100, 101), (101, 102)}
    t = spark.createDataFrame([triple(f"{a}-{b}", f"n{a}", f"n{b}", c=float(rng.random()) + 0.1) for a, b in sorted(pairs)], TRIPLE)
    adj = spectral.adjacency(t).cache()
    nodes = sorted({r.src for r in adj.collect()})
    m = np.zeros((len(nodes), len(nodes)))
    for r in adj.collect():
        m[nodes.index(r.src), nodes.index(r.dst)] += r.w
    s = 1 / np.sqrt(m.sum(1))
    want = np.linalg.eigvalsh(np.eye(len(nodes)) - m * s[:, None] * s[None, :])
    values, _ = spectral._smallest(spectral._Held(adj), 3, 1e-5, 300)
    assert np.abs(values - want[1:4]).max() < 1e-6
    assert spectral.spectral_gap(adj) == 1e-10 and spectral.spectral_gap(adj.where("src not like 'n10%'")) > 1e-3  # two components, one
    assert len({r.id: r.importance for r in spectral.importance(adj, 200).collect()}) == spectral.clusters(adj).count() == len(nodes)
    with pytest.raises(RuntimeError):
        spectral._smallest(spectral._Held(adj), 3, 1e-12, 2)


def several(spark, sizes):
    rng = random.Random(4)
    pairs = [(c, i, (i + 1) % n) for c, n in enumerate(sizes) for i in range(n) if n > 2 or i == 0]
    return spectral.adjacency(spark.createDataFrame([triple(f"{c}-{i}", f"n{c}-{i}", f"n{c}-{j}", c=rng.random() + 0.1) for c, i, j in pairs], TRIPLE)).cache()


def dense(adj):
    rows = adj.collect()
    nodes = sorted({r.src for r in rows})
    m = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        m[nodes.index(r.src), nodes.index(r.dst)] += r.w
    s = 1 / np.sqrt(m.sum(1))
    first = np.sqrt(m.sum(1) / m.sum())
    values, x = np.linalg.eigh(np.eye(len(nodes)) - m * s[:, None] * s[None, :] + 3 * np.outer(first, first))  # the first vector comes last
    return nodes, values[:-1], x[:, :-1]


def test_many_components_need_no_iteration(spark, monkeypatch):
    monkeypatch.setattr(spectral, "_engine", lambda *_: pytest.fail("the vectors of components are known"))
    adj = several(spark, [9, 7, *[2] * 50])
    nodes, values, x = dense(adj)
    want = (x[:, values < 1e-9] ** 2).sum(1)
    got = {r.id: r.importance for r in spectral.importance(adj, 2000).collect()}
    assert np.abs(np.array([got[n] for n in nodes]) - want / want.max()).max() < 1e-9
    own = {r.id: r.cluster for r in spectral.clusters(adj).collect()}
    whole = {c: {own[n] for n in nodes if n.startswith(f"n{c}-")} for c in range(52)}
    assert set(own) == set(nodes) and all(len(v) == 1 for v in whole.values()) and set(own.values()) == set(range(32)) and whole[0] != whole[1]


@pytest.mark.parametrize("local_links", [1_000_000, 0])
def test_some_components_and_what_lies_beyond(spark, local_links):
    adj = several(spark, [5, 4])
    nodes, values, x = dense(adj)
    want = (x[:, :3] ** 2 / np.maximum(values[:3], 1e-10)).sum(1)
    got = {r.id: r.importance for r in spectral.importance(adj, 200, local_links, tolerance=1e-5).collect()}
    assert np.abs(np.array([got[n] for n in nodes]) - want / want.max()).max() < 1e-6
    graph = spectral.Graph(adj)
    _, _, beyond, _ = spectral._beyond(graph, 3, local_links, 1e-5, 100)
    assert graph.n_parts == 2 and np.abs(beyond - values[1:3]).max() < 1e-6
    own = {r.id: r.cluster for r in spectral.clusters(graph, local_links, most=2).collect()}
    assert set(own) == set(nodes) and not {own[n] for n in nodes if n[1] == "0"} & {own[n] for n in nodes if n[1] == "1"}


def test_consolidation_order(spark):
    e = spark.createDataFrame([("a", "Ada", 0.0, 0.9, 1), ("a2", "ada", 1.0, 0.9, 1), ("b", "Bob", 0.0, 0.9, 1), ("o", "Orphan", 0.0, 0.9, 0)], "id string, name string, created_at double, confidence double, access_count bigint")
    t = [triple(str(i), "a", v="x", c=0.04, src=f"s{i}") for i in range(3)] + [triple("e", "a2", "b"), triple("self", "a", "a2"), triple("low", "b", v="y", c=0.01)]
    e2, t2 = consolidation.consolidate(e, spark.createDataFrame(t, TRIPLE), now=1.0)
    left = {r.id: (r.subject_id, r.valid_until) for r in t2.collect()}
    assert {r.id for r in e2.collect()} == {"a", "b"}
    assert len(left) == 3 and left["e"][0] == "a" and left["low"][1] == 1.0 and [k for k in left if k in "012"] == ["0"]
    assert left["0"][1] is None  # promoted before it could be pruned


def test_compression_tiers(spark):
    e = spark.createDataFrame([(x, f"Name {x}") for x in "abcd"], "id string, name string")
    t = spark.createDataFrame([triple(f"{x}{y}", x, y, c=0.5) for x in "abcd" for y in "abcd" if x < y], TRIPLE)
    for b, kind in ((50, "L0"), (200, "L1"), (2000, "L2"), (9000, "L3")):
        r = compression.compress(e, t, b).first()
        assert r.tier == kind and r.token_estimate <= b and r.n_lines >= 1


def test_evaluation(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["b"]), (2, ["a", "b"], ["a", "z"]), (3, ["a"], [])], "qid int, ranked array<string>, gold array<string>")
    r = {x.qid: x for x in evaluation.bundle(df, (2,)).withColumn("h", evaluation.ndcg_retrieved(F.col("ranked"), F.col("gold"), 3)).collect()}
    assert (r[1].recall_any_2, r[1].recall_all_2, r[1].ndcg_2) == (1.0, 1.0, 1.0)  # rank 2 is not discounted
    assert (r[2].recall_any_2, r[2].recall_all_2, r[2].ndcg_2) == (1.0, 0.0, 0.5)
    assert (r[3].recall_any_2, r[3].recall_all_2, r[3].ndcg_2, r[3].h) == (0.0, 0.0, 0.0, 0.0)
    assert abs(r[1].h - 1 / np.log2(3)) < 1e-12


def test_competition_ranks_and_blend(spark):
    s = spark.createDataFrame([("f", "a", 2.0), ("f", "b", 2.0), ("f", "c", 1.0), ("f", "d", float("nan"))], "by string, id string, score double")
    assert {r.id: r["rank"] for r in retrieval.competition_ranks(s, "by").collect()} == {"a": 1, "b": 1, "c": 3, "d": 4}
    r = spark.createDataFrame([(1, "a", 1.0, 0.2), (1, "b", 0.8, 0.9), (1, "c", 0.5, 1.0)], "qid int, id string, score double, rerank double")
    f = {x.id: x.final for x in retrieval.final_blend(r, 2).collect()}
    assert abs(f["a"] - 0.6) < 1e-9 and abs(f["b"] - 0.88) < 1e-9 and f["c"] < f["a"]


def test_rerank_with_model(spark):
    df = spark.createDataFrame([("q", "ab"), ("q", None)], "query string, text string")
    assert [r.rerank for r in retrieval.rerank_with(df, lambda pairs: [float(len(t)) for _, t in pairs]).collect()] == [2.0, 0.0]


def test_ingest(spark):
    m = spark.createDataFrame([("1", 1.0, "Ada uses Rust. Ada uses Zig."), ("2", 2.0, "Ada is Baroness"), ("3", 3.0, "Ada is Retired"), ("4", 4.0, None)], "id string, timestamp double, content string")
    a = {(r.predicate, r.object_key): (r.replaces, r.seq) for r in ingest.assertions(ingest.extract(m)).collect()}
    assert a["is", "baroness"] == (True, 1) and a["is", "retired"] == (True, 2) and not a["uses", "rust"][0]
    known = spark.createDataFrame([("x", "ADA", None, 0.5)], "id string, name string, entity_type string, created_at double")
    names = spark.createDataFrame([(" ada ", "person", 1.0), ("Bob", None, 2.0), ("", None, 2.0)], "name string, entity_type string, at double")
    r = {x.name_key: (x.id == "x", x.entity_type, x.is_new) for x in ingest.resolve(names, known).collect()}
    assert r == {"ada": (True, "person", False), "bob": (False, None, True)}


def test_model_extraction(spark):
    m = spark.createDataFrame([("1", 1.0, "x"), ("2", 2.0, "y")], "id string, timestamp double, content string")
    answer = '```json\n{"entities": ["Ada"], "facts": [{"subject": "Ada", "predicate": "is", "object": "here"}]}\n```'
    r = {x.id: (x.names, len(x.facts)) for x in ingest.extract_with(m, lambda texts: [answer if t == "x" else "no" for t in texts]).collect()}
    assert r == {"1": (["Ada"], 1), "2": ([], 0)}


def test_archive(spark, tmp_path):
    m = spark.createDataFrame([("1", 1.0, "user", "hé", "s", None), ("2", 2.0, None, None, None, "{}"), ("3", 3.0, "user", "", "s", None)], "id string, timestamp double, role string, content string, session_id string, metadata string")
    path = str(tmp_path / "a")
    archive.write_archive(archive.retention(m, before=2.5), path)
    back = archive.read_archive(spark, path)
    assert sorted(r.id for r in back.where("ok").collect()) == ["1", "2"]
    assert archive.restore(m.where("id = '3'"), back).count() == 3
    lines = sorted((r.value for r in spark.read.text(path).collect()), key=lambda x: "hé" not in x)
    bad = spark.createDataFrame([(lines[0].replace("hé", "ho"),), ("{",), (lines[1].replace(archive.FORMAT, "other"),)], "value string")
    assert [r.error for r in archive.decode(bad).collect()] == ["checksum", "json", "format"]
    assert not archive.decode(bad).where("ok").where("content = 'ho'").count()
    assert [r.id for r in archive.retention(m, keep_latest=1).orderBy("id").collect()] == ["1", "2"]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"), "team")
    df = spark.range(5)
    assert s.publish(a=df, b=df) == {"a": 1, "b": 1}
    assert s.publish(a=spark.range(7)) == {"a": 2, "b": 1}
    assert s.read("a").count() == 7 and s.read("a", 1).count() == 5 and s.size() > 0
    s.compact("a", 1)
    assert s.versions()["a"] == 3 and s.drop_old("a", keep=1) == 2 and s.read("a").count() == 7


def test_streaming(spark, tmp_path):
    from sediment.streaming.ingest import append_new, live_supersession

    src = str(tmp_path / "in")
    rows = [("a", "p", "x", 1.0), ("a", "p", "y", 5.0), ("a", "p", "z", 3.0), ("b", "p", "x", 1.0), (None, "p", "x", 1.0)]
    spark.createDataFrame(rows, "subject_id string, predicate string, value string, valid_from double").write.parquet(src)
    stream = spark.readStream.schema("subject_id string, predicate string, value string, valid_from double").parquet(src)
    q = live_supersession(stream).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = sorted((r.value, r.valid_until, r.status) for r in spark.table("live").collect())
    assert got == [("x", 3.0, "closed"), ("z", 5.0, "closed")]
    msgs = str(tmp_path / "m")
    spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "id string, content string").write.parquet(msgs)
    q = append_new(spark.readStream.schema("id string, content string").parquet(msgs), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_periods_with_infinite_times(spark):
    from sediment.functions.keys import OPEN, end_or_open, valid_period

    rows = [(0.0, None), (0.0, float("inf")), (float("inf"), None), (float("nan"), 1.0), (1.0, float("nan")), (5.0, 5.0), (None, 1.0), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "f double, u double").where(valid_period(F.col("f"), F.col("u")))
    assert [tuple(r) for r in df.select(F.col("f").cast("bigint"), end_or_open(F.col("u"))).collect()] == [(0, OPEN), (0, OPEN), (1, 2)]
