"""Spectral analytics: adjacency, Laplacian, gap, clusters and importance.

Tables stay distributed. The smallest eigenvalues of the Laplacian and their vectors come from one iteration, a block
conjugate gradient with Rayleigh-Ritz steps, that ends when the residuals are below a stated tolerance and is an error if
they don't get there. Its vectors lie in the driver up to a stated number of links, beyond that in a table; the steps are the same.
The eigenvalue 0 needs no iteration: it has one vector for each component, the roots of the degrees there. Only what lies beyond these is iterated for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators.components import components
from sediment.session import cut

#: Weights of the kinds of relation.
WEIGHTS = {"fact": 1.0, "causal": 1.5, "depends": 1.2, "supersedes": 0.5, "contradicts": 0.3}


def adjacency(triples: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``w``: open triples between entities, weight by relation times confidence, both ways, parallel ones summed, a loop twice."""
    w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("relation_type")), F.lit(1.0)) * F.coalesce("confidence", F.lit(1.0))
    e = triples.where("object_id is not null and valid_until is null").select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"), w.alias("w"))
    both = F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")), F.struct(F.col("o").alias("src"), F.col("s").alias("dst"))))
    return e.select(both.alias("e"), "w").groupBy("e.src", "e.dst").agg(F.sum("w").alias("w"))


def weighted_degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def laplacian(adj: DataFrame) -> DataFrame:
    """Entries of I - D^-1/2 A D^-1/2 that are not zero, of nodes with links: ``src``, ``dst``, ``v``."""
    d = weighted_degree(adj).where("degree > 0")
    a, b = d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    off = adj.join(a, "src").join(b, "dst").select("src", "dst", (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("v"))
    return off.unionByName(d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("v"))).groupBy("src", "dst").agg(F.sum("v").alias("v"))


def decay_operator(entities: DataFrame, adj: DataFrame, now: float, half_life_days: float = 30.0) -> DataFrame:
    """``id``, ``confidence`` and ``new_confidence``: 0.6 of the neighbours' mean + 0.2 by access + 0.2 by age, scaled to a largest of 1."""
    c = entities.select(F.col("id").alias("dst"), F.coalesce("confidence", F.lit(1.0)).alias("c"))
    d = weighted_degree(adj).where("degree > 0")
    spread = adj.join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("c")).alias("_s")).join(d, "id").select("id", (F.col("_s") / F.col("degree")).alias("spread"))
    e = entities.select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.log1p(F.coalesce("access_count", F.lit(0))).alias("acc"), F.greatest(F.lit(now) - F.col("created_at"), F.lit(0.0)).alias("age"))
    e = e.join(spread, "id", "left").fillna(0.0, ["spread"])
    most = e.agg(F.max("acc").alias("_m"))
    access = F.when(F.col("_m") > 0, F.col("acc") / F.col("_m")).otherwise(F.col("acc"))
    raw = 0.6 * F.col("spread") + 0.2 * access * F.col("confidence") + 0.2 * F.exp(-F.log(F.lit(2.0)) * F.col("age") / 86400 / half_life_days) * F.col("confidence")
    e = e.crossJoin(F.broadcast(most)).withColumn("raw", raw)
    top = e.agg(F.max("raw").alias("_t"))
    scaled = F.when(F.col("_t") > 0, F.col("raw") / F.col("_t")).otherwise(F.col("raw"))
    return e.crossJoin(F.broadcast(top)).select("id", "confidence", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("new_confidence"))


def radius(gap: Column) -> Column:
    return F.when(gap <= 0, 10).otherwise(F.greatest(F.lit(1), F.least(F.ceil(2 / gap), F.lit(15)))).cast("int")


class Graph:
    """A graph with its components: ``adj``; ``nodes`` (``id``, ``degree``, ``component``) of those with weight; ``parts`` (``component``, ``vol``, ``n``), one row for each."""

    def __init__(self, adj: DataFrame) -> None:
        self.adj = cut(adj)
        own = components(self.adj.where("w <> 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
        self.nodes = cut(weighted_degree(self.adj).where("degree > 0").join(own, "id", "left").withColumn("component", F.coalesce("component", "id")))
        self.parts = cut(self.nodes.groupBy("component").agg(F.sum("degree").alias("vol"), F.count("*").alias("n")))
        whole = self.parts.agg(F.count("*").alias("n_parts"), F.sum("vol").alias("vol"), F.sum("n").alias("n")).first()
        self.n_parts, self.vol, self.n = whole.n_parts, whole.vol or 1.0, whole.n or 0

    def largest(self, k: int) -> list:
        """The ``k`` largest components, by weight."""
        return self.parts.orderBy(F.desc("vol"), "component").limit(k).collect()

    def numbered(self, parts: list) -> DataFrame:
        """``id`` and ``part``, the place of each node's component in ``parts``, of all nodes; those of no such component come after the last."""
        at = self.adj.sparkSession.createDataFrame([(r.component, i) for i, r in enumerate(parts)], "component string, part int")
        of = self.nodes.select("id", F.col("component").cast("string").alias("component")).join(F.broadcast(at), "component").select("id", "part")
        return self.adj.select(F.col("src").alias("id")).distinct().join(of, "id", "left").fillna(len(parts), ["part"])


def _contrasts(vol: np.ndarray) -> np.ndarray:
    """For components of weights ``vol`` the vectors of eigenvalue 0 beyond the first: each sets one component against all after it. Entry by unit vector of a component and vector."""
    rest = np.append(np.cumsum(vol[::-1])[::-1], 0.0)[1:]
    out = np.zeros((len(vol), len(vol) - 1))
    for j in range(len(vol) - 1):
        out[j, j] = (rest[j] / (vol[j] + rest[j])) ** 0.5
        out[j + 1 :, j] = -np.sqrt(vol[j + 1 :] / rest[j] * vol[j] / (vol[j] + rest[j]))
    return out


class _Held:
    """The normalised adjacency of a graph that fits into the driver, and blocks of vectors over its nodes. With ``part``, the number of a link's component, the vectors of all components are known."""

    def __init__(self, adj: DataFrame, zeros: int = 1) -> None:
        t = adj.select("src", "dst", "w", *(["part"] if zeros > 1 else [])).toArrow()  # at most local_links rows
        ends = pa.chunked_array([c.cast(pa.string()) for side in ("src", "dst") for c in t[side].chunks], pa.string())
        self.nodes = pc.unique(ends)
        self.nodes = self.nodes.take(pc.sort_indices(self.nodes))
        at = pc.index_in(ends, self.nodes).to_numpy()
        i, j, w = at[: len(t)], at[len(t) :], t["w"].to_numpy().astype(float)
        self.part_of, self.zeros = np.zeros(len(self.nodes), int), zeros
        if zeros > 1:
            self.part_of[i] = t["part"].to_numpy()
        order = np.argsort(i, kind="stable")
        self.j, w, i = j[order], w[order], i[order]
        self.first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        self.rows, self.n = i[self.first], len(self.nodes)
        d = np.bincount(i, w, self.n)
        self.root = np.sqrt(np.maximum(d, 0))
        s = np.where(d > 0, 1 / np.maximum(self.root, 1e-150), 0)
        self.v = w * s[i] * s[self.j]

    def start(self, b: int) -> np.ndarray:
        return np.random.default_rng(42).normal(size=(self.n, b))

    def known(self) -> np.ndarray:
        z = self.root[:, None] * (self.part_of[:, None] == np.arange(self.zeros))
        return z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for c in range(0, x.shape[1], 4):
            out[self.rows, c : c + 4] = np.add.reduceat(self.v[:, None] * x[self.j, c : c + 4], self.first, axis=0)
        return out

    gram = staticmethod(lambda x: x.T @ x)
    mix = staticmethod(lambda x, c: x @ c)
    join = staticmethod(lambda *parts: np.hstack(parts))
    part = staticmethod(lambda x, i, n: x[:, i * n : (i + 1) * n])

    def frame(self, x: np.ndarray, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"id": self.nodes, "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))}))


class _Spread:
    """The same for a graph of any size: blocks are tables of ``id`` and ``x`` (array<double>)."""

    def __init__(self, adj: DataFrame, zeros: int = 1) -> None:
        part = F.min("part") if zeros > 1 else F.lit(0)
        self.d, self.zeros = cut(adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"), part.alias("part")).where("degree > 0")), zeros
        a, b = self.d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), self.d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
        self.links = cut(adj.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("v")))
        self.n, self.totals = self.d.count(), {r.part: r.t for r in self.d.groupBy("part").agg(F.sum("degree").alias("t")).collect()}  # a row for each component, at most ``zeros``

    def start(self, b: int) -> DataFrame:
        return cut(self.d.select("id", F.array(*(F.xxhash64("id", F.lit(i)) / 2.0**63 for i in range(b))).alias("x")))

    def known(self) -> DataFrame:
        return self.d.select("id", F.array(*(F.when(F.col("part") == i, F.sqrt(F.col("degree") / self.totals.get(i, 1.0))).otherwise(0.0) for i in range(self.zeros))).alias("x"))

    def apply(self, x: DataFrame) -> DataFrame:
        b = len(x.first().x)
        y = self.links.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("v") * F.col("x")[i]).alias(f"y{i}") for i in range(b)))
        return cut(self.d.select("id").join(y, "id", "left").select("id", F.array(*(F.coalesce(f"y{i}", F.lit(0.0)) for i in range(b))).alias("x")))

    @staticmethod
    def _rows(batch: pa.RecordBatch) -> np.ndarray:
        x = batch["x"]
        return x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 0))

    @classmethod
    def gram(cls, x: DataFrame) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    m = cls._rows(batch)
                    total = m.T @ m if total is None else total + m.T @ m
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

        parts = [np.array(r.g) for r in x.select("x").mapInArrow(run, "g array<double>").collect()]  # a small matrix a task
        total = np.sum(parts, axis=0)
        return total.reshape(int(len(total) ** 0.5), -1)

    @classmethod
    def mix(cls, x: DataFrame, c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(cls._rows(batch) @ c), pa.list_(pa.float64()))], names=["id", "x"])

        return cut(x.select("id", "x").mapInArrow(run, "id string, x array<double>"))

    @staticmethod
    def join(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for i, p in enumerate(parts[1:]):
            out = out.join(p.withColumnRenamed("x", f"_x{i}"), "id").select("id", F.concat("x", f"_x{i}").alias("x"))
        return out

    @staticmethod
    def part(x: DataFrame, i: int, n: int) -> DataFrame:
        return x.select("id", F.slice("x", i * n + 1, n).alias("x"))

    @staticmethod
    def frame(x: DataFrame, spark: SparkSession) -> DataFrame:
        return x


def _engine(adj: DataFrame, local_links: int, zeros: int = 1) -> _Held | _Spread:
    return (_Held if adj.limit(local_links + 1).count() <= local_links else _Spread)(adj, zeros)


def _smallest(op: _Held | _Spread, k: int, tolerance: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray | DataFrame]:
    """The ``k`` smallest eigenvalues of the Laplacian beyond those of the known vectors, which are 0, and their vectors: those of the largest of the normalised adjacency, orthogonal to the
    known. Each round widens the block of vectors by its residuals and its last steps and keeps the best; it ends when all ``k`` residuals are below ``tolerance``."""
    b = min(k + 2, op.n - op.zeros)
    k = min(k, b)
    x, p = op.start(b), None
    z = op.known()
    nx = np_ = None
    for _ in range(most_rounds):
        if nx is None:
            x = _cleared(op, op.join(z, x), b)
            nx = op.apply(x)
        # within the block: X' X and X' N X from one Gram matrix
        g = op.gram(op.join(x, nx))
        c, mu = _ritz(g[:b, :b], g[:b, b:], b)
        both = op.mix(op.join(x, nx), np.block([[c, np.zeros_like(c), -c * mu], [np.zeros_like(c), c, c]]))  # X, N X, residuals N X - X mu
        width = c.shape[1]
        size = np.sqrt(np.maximum(np.diag(op.gram(both))[2 * width :], 0))
        x, nx, r = (op.part(both, i, width) for i in range(3))
        if (size[:k] < tolerance).all():
            return 1 - mu[:k], op.part(x, 0, k)
        r = _cleared(op, op.join(z, r), width)
        nr = op.apply(r)
        parts = [x, r] if p is None else [x, r, p]
        images = [nx, nr] if p is None else [nx, nr, np_]
        whole = op.join(*parts, *images)
        g = op.gram(whole)
        m = g.shape[0] // 2
        c, _ = _ritz(g[:m, :m], g[:m, m:], b)
        zero = np.zeros_like(c)
        step = c.copy()
        step[:width] = 0
        new = op.mix(whole, np.block([[c, zero, step, zero], [zero, c, zero, step]]))
        n = c.shape[1]
        x, nx, p, np_ = (op.part(new, i, n) for i in range(4))
        b = n
    raise RuntimeError(f"the eigenvalues are not known to {tolerance} after {most_rounds} rounds")


def _cleared(op: _Held | _Spread, zx: np.ndarray | DataFrame, b: int):
    """The last ``b`` columns without the parts along the ones before, which are orthogonal to each other, each at length one."""
    g = op.gram(zx)
    z = len(g) - b
    c = np.vstack([-g[:z, z:] / np.maximum(np.diag(g)[:z, None], 1e-300), np.eye(b)])
    length = np.sqrt(np.maximum(np.diag(c.T @ g @ c), 1e-300))
    return op.mix(zx, c / length)


def _ritz(g: np.ndarray, h: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the space with Gram matrix ``g`` the ``b`` best combinations and their values; directions that are nearly dependent are left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    w, q = np.linalg.eigh(scale[:, None] * g * scale)
    keep = w > 1e-10 * max(w.max(), 1e-300)
    base = scale[:, None] * q[:, keep] / np.sqrt(w[keep])
    values, c = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
    best = np.argsort(-values)[:b]
    return base @ c[:, best], values[best]


def spectral_gap(adj: DataFrame, local_links: int = 1_000_000, tolerance: float = 1e-5, most_rounds: int = 1000) -> float:
    """The second smallest eigenvalue of the Laplacian, at least 1e-10; 1.0 for fewer than three nodes. A graph of several components has none: 1e-10.

    The residual is at most ``tolerance``, so the value is exact to its square over the distance to the next eigenvalue, at any size of graph.
    """
    adj = cut(adj)
    if adj.select("src").distinct().limit(3).count() < 3:
        return 1.0
    if _parts(adj) > 1:
        return 1e-10
    return max(float(_smallest(_engine(adj, local_links), 1, tolerance, most_rounds)[0][0]), 1e-10)


def _components(adj: DataFrame) -> DataFrame:
    own = components(adj.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return adj.select(F.col("src").alias("node")).distinct().join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _parts(adj: DataFrame) -> int:
    return _components(adj).select("component").distinct().count()


def _kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """``weight``: how often each point stands, if not once."""
    rng = np.random.default_rng(seed)
    many = np.ones(len(x)) if weight is None else weight
    c = [x[rng.integers(len(x)) if weight is None else rng.choice(len(x), p=weight / weight.sum())]]
    while len(c) < k:
        d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0) * many
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(c)
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.array([((x - m) ** 2).sum(1) for m in c]).argmin(0)
        if (new == own).all() and _:
            break
        own = new
        c = np.array([np.average(x[own == j], axis=0, weights=many[own == j]) if (own == j).any() else c[j] for j in range(k)])
    return own


def _beyond(graph: Graph, k: int, local_links: int, tolerance: float, most_rounds: int):
    """For a graph of at most ``k`` components: the engine and its known vectors' components, and the eigenvalues, ``k`` in all with the zeros beyond the first, that aren't 0, with their vectors (None if there are none)."""
    parts = graph.largest(k)
    adj = graph.adj if len(parts) <= 1 else graph.adj.join(graph.numbered(parts).withColumnRenamed("id", "src"), "src")
    op = _engine(adj, local_links, max(len(parts), 1))
    k = min(k - op.zeros + 1, op.n - op.zeros)
    values, x = _smallest(op, k, tolerance, most_rounds) if k > 0 else (np.zeros(0), None)
    return op, parts, values, x


def clusters(adj: DataFrame | Graph, local_links: int = 1_000_000, most: int = 32, seed: int = 42, tolerance: float = 1e-4, most_rounds: int = 1000) -> DataFrame:
    """``id``, ``cluster`` of all nodes with links, at any size of graph: as many clusters, up to ``most``, as stand before the widest gap of the eigenvalues; k-means over the nodes' entries in
    those eigenvectors. Fewer than three nodes are one cluster.

    The vectors of eigenvalue 0 are those of the components, each against all smaller ones. If there are more components than eigenvalues asked for, all of these are 0 and no gap is among them:
    there are ``most`` clusters, of whole components, whose nodes have the same entries, so that k-means needs a point for each with its number of nodes.
    """
    graph = adj if isinstance(adj, Graph) else Graph(adj)
    spark, adj = graph.adj.sparkSession, graph.adj
    n = adj.select("src").distinct().limit(2 * most + 2).count()
    if n < 3:
        return adj.select(F.col("src").alias("id")).distinct().withColumn("cluster", F.lit(0))
    asked = min(most, n // 2) + 1
    if graph.n_parts > asked:
        k = asked - 1
        parts = graph.largest(k)
        vol, size = [r.vol for r in parts], [r.n for r in parts]
        vol, size = np.array([*vol, graph.vol - sum(vol)]), np.array([*size, graph.n - sum(size)])
        points = _contrasts(vol) / np.sqrt(vol)[:, None]
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        own = np.unique(_kmeans(points, k, seed, weight=size), return_inverse=True)[1]
        return graph.numbered(parts).select("id", F.get(F.array(*(F.lit(int(c)) for c in own)), F.col("part")).alias("cluster"))
    op, parts, values, x = _beyond(graph, asked, local_links, tolerance, most_rounds)
    if op.zeros > 1:
        zero = _contrasts(np.array([r.vol for r in parts]))
        known = op.mix(op.known(), zero)
        values, x = np.append(np.zeros(op.zeros - 1), values), known if x is None else op.join(known, x)
    gaps = np.diff(values)
    k = min(int(np.argmax(gaps)) + 2 if len(gaps) else 2, max(1, n // 2)) if n <= 2 * most else (int(np.argmax(gaps)) + 2 if len(gaps) else 2)
    kept = op.mix(x, np.eye(len(values))[:, : min(k, len(values))])
    if isinstance(op, _Held):
        x = kept / np.maximum(np.linalg.norm(kept, axis=1, keepdims=True), 1e-12)
        own = np.unique(_kmeans(x, k, seed), return_inverse=True)[1]
        return spark.createDataFrame(pa.table({"id": op.nodes, "cluster": pa.array(own, pa.int32())}))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    rows = cut(kept.select("id", array_to_vector(F.transform("x", lambda v: v / F.greatest(norm, F.lit(1e-12)))).alias("features")))
    return KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def importance(adj: DataFrame | Graph, budget: int, local_links: int = 1_000_000, tolerance: float = 1e-4, most_rounds: int = 1000) -> DataFrame:
    """``id``, ``importance`` in [0, 1], at any size of graph: the sum of squared eigenvector entries by eigenvalue over the smallest beyond the first. Fewer than three nodes: all 1.

    The vectors of eigenvalue 0, one for each component beyond the first, may be turned into each other at will, so they count all together, as the sum over them doesn't depend on that:
    degree / (its component's sum) - degree / (sum of all). Others follow if fewer zeros are there than eigenvalues asked for.
    """
    graph = adj if isinstance(adj, Graph) else Graph(adj)
    spark, adj = graph.adj.sparkSession, graph.adj
    ids = adj.select(F.col("src").alias("id")).distinct()
    n = ids.limit(22).count()
    if n < 3:
        return ids.withColumn("importance", F.lit(1.0))
    k = max(2, min(int((budget // 15) ** 0.5) + 1, n - 1, 20)) - 1
    zero = graph.nodes.join(graph.parts, "component").select("id", ((F.col("degree") / F.col("vol") - F.col("degree") / graph.vol) / 1e-10).alias("_r"))
    raw = ids.join(zero, "id", "left") if graph.n_parts > 1 else ids.withColumn("_r", F.lit(0.0))
    if graph.n_parts <= k:
        op, _, values, x = _beyond(graph, k, local_links, tolerance, most_rounds)
        if x is not None:
            weights = F.array(*(F.lit(float(1 / max(v, 1e-10))) for v in values))
            more = op.frame(x, spark).select("id", F.aggregate(F.zip_with("x", weights, lambda v, w: v * v * w), F.lit(0.0), lambda a, v: a + v).alias("_m"))
            raw = raw.join(more, "id", "left").select("id", (F.coalesce("_r", F.lit(0.0)) + F.coalesce("_m", F.lit(0.0))).alias("_r"))
    raw = cut(raw.fillna(0.0, ["_r"]))
    top = raw.agg(F.max("_r").alias("_t"))
    return raw.crossJoin(F.broadcast(top)).select("id", F.when(F.col("_t") > 0, F.col("_r") / F.col("_t")).otherwise(0.0).alias("importance"))


def local_gap(triples: DataFrame, start: DataFrame, steps: int = 5) -> tuple[float, int]:
    """Gap and radius of the graph around the entities ``start`` (``id``): of all links between entities within ``steps`` steps. Fewer than three entities: (1.0, 1)."""
    from sediment.operators.graph import neighbourhood

    t = triples.where("valid_until is null and object_id is not null")
    near = neighbourhood(t, start, steps)
    part = t.join(near.select(F.col("triple_id").alias("id")), "id", "left_semi")
    adj = cut(adjacency(part))
    if adj.select("src").distinct().limit(3).count() < 3:
        return 1.0, 1
    gap = spectral_gap(adj)
    return gap, 10 if gap <= 0 else max(1, min(int(np.ceil(2 / gap)), 15))
