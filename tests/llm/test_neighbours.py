import numpy as np

from sediment.llm.neighbours import FlatGraph, VectorIndex, nearest

SCHEMA = "tbl string, id string, vec array<float>, cell int, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, dim))
    v = c[rng.integers(12, size=n)] + 0.35 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall():
    v = clustered(3000, 32, 1)
    near, sim = FlatGraph(v).search(v[:300], 11, 48)
    want = np.argsort(-(v[:300] @ v.T), axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(near, want, strict=True)]) > 0.95
    assert (np.diff(sim, axis=1) <= 1e-6).all()


def test_tiny_graphs():
    for n in (0, 1, 2, 5):
        near, _ = FlatGraph(clustered(max(n, 1), 8, n)[:n]).search(clustered(3, 8, 9), 4, 8)
        assert near.shape == (3, 4) and ((near >= 0).sum(1) == min(n, 4)).all()


def test_recall_over_shards(spark):
    v = clustered(3000, 16, 3)
    rows = [("a", f"v{i:05}", [float(x) for x in v[i]]) for i in range(len(v))]
    got = nearest(frame(spark, rows), None, dim=16, shard_rows=300, cells_probed=6).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.id, set()).add(r.neighbour_id)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    recall = np.mean([len({f"v{j:05}" for j in want[i]} & mine[f"v{i:05}"]) / 10 for i in range(len(v))])
    assert len(mine) == 3000 and all(len(x) == 10 for x in mine.values()) and recall >= 0.9


def test_dirty_vectors(spark):
    good = [("a", f"g{i}", [float(i + 1), 1.0, 0.0]) for i in range(5)] + [("b", "g0", [1.0, 0.0, 0.0])]
    bad = [("a", "n", None), ("a", "s", [1.0]), ("a", "z", [0.0, 0.0, 0.0]), ("a", "f", [float("nan"), 1.0, 1.0]), ("a", "i", [float("inf"), 1.0, 1.0]), ("a", "e", []), ("a", "m", [1.0, None, 1.0]), ("a", None, [1.0, 1.0, 1.0])]
    df = frame(spark, good + bad + good[:2])
    got = sorted((r.tbl, r.id, r.neighbour_id) for r in nearest(df, None, k=10, dim=3).collect())
    assert got == sorted(("a", f"g{i}", f"g{j}") for i in range(5) for j in range(5) if i != j)
    probes = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("a", "z"), ("a", "unknown")], "tbl string, id string")
    assert {r.id for r in nearest(df, probes, k=2, dim=3).collect()} == {"g1"}
    assert nearest(df.limit(0), None, dim=3).count() == 0


def test_a_third_of_equal_vectors(spark):
    v = clustered(1000, 8, 6)
    rows = [("a", f"v{i:05}", [float(x) for x in v[i]]) for i in range(1000)] + [("a", f"e{i:05}", [float(x) for x in v[0]]) for i in range(500)]
    got = nearest(frame(spark, rows), spark.createDataFrame([("a", "e00001"), ("a", "v00500")], "tbl string, id string"), dim=8, shard_rows=60).collect()
    equal = [r for r in got if r.id == "e00001"]
    assert len(equal) == 10 and all(r.sim > 0.9999 for r in equal) and len([r for r in got if r.id == "v00500"]) == 10


def test_more_cells_are_probed_where_there_are_more(spark):
    v = clustered(3000, 16, 8)
    rows = [("a", f"v{i:05}", [float(x) for x in v[i]]) for i in range(len(v))]
    probes = spark.createDataFrame([("a", f"v{i:05}") for i in range(400)], "tbl string, id string")
    mine = {}
    for r in nearest(frame(spark, rows), probes, dim=16, shard_rows=40, cells_probed=4).collect():  # 98 cells
        mine.setdefault(r.id, set()).add(r.neighbour_id)
    s = v[:400] @ v.T
    s[np.arange(400), np.arange(400)] = -2
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len({f"v{j:05}" for j in want[i]} & mine[f"v{i:05}"]) / 10 for i in range(400)]) >= 0.95



def test_cells_in_two_levels(spark):
    v = clustered(3000, 16, 8)
    rows = [("a", f"v{i:05}", [float(x) for x in v[i]]) for i in range(len(v))]
    probes = spark.createDataFrame([("a", f"v{i:05}") for i in range(400)], "tbl string, id string")
    mine = {}
    for r in nearest(frame(spark, rows), probes, dim=16, shard_rows=40, flat_cells=5).collect():  # ten coarse cells of some ten each
        mine.setdefault(r.id, set()).add(r.neighbour_id)
    s = v[:400] @ v.T
    s[np.arange(400), np.arange(400)] = -2
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len({f"v{j:05}" for j in want[i]} & mine[f"v{i:05}"]) / 10 for i in range(400)]) >= 0.9


def test_index_is_stored_and_asked_again(spark, tmp_path):
    v = clustered(900, 16, 2)
    df = frame(spark, [("a", f"v{i:05}", [float(x) for x in v[i]]) for i in range(len(v))])
    VectorIndex(spark, str(tmp_path / "i"), 16, shard_rows=100).build(df)
    again = VectorIndex(spark, str(tmp_path / "i"), 16, shard_rows=100)
    one, parts = (sorted(map(tuple, again.search(df, 5, query_rows=n).collect())) for n in (10**6, 60))
    assert one == parts and len(one) == 4500  # the queries of a cell may be split
    flat = spark.read.parquet(f"{again.path}/shards")
    assert flat.count() == len(again.cells()["a"].fine) and flat.selectExpr("sum(size(ids))").first()[0] == 900


def test_graph_by_insertion():
    for n in (1000, 8000):
        v = clustered(n, 16, n)
        g = FlatGraph(v)
        nodes, near = g.levels[0]
        assert len(nodes) == n and near.shape == (n, 32) and ((near >= 0).sum(1) > 0).all()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(near))
        back, sim = FlatGraph.of(v, g.levels).search(v[:200], 11, 48)
        want = np.argsort(-(v[:200] @ v.T), axis=1)[:, :11]
        assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(back, want, strict=True)]) > 0.97
