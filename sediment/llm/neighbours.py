"""The k most similar vectors of each query vector, by small-world graphs.

Vectors are spread over cells around centroids, whose number grows with the table: up to a thousand from one bounded sample,
more in two levels, each coarse cell being split by a sample of its own. Every vector is indexed; a cell of more than
``2 * shard_rows`` vectors is split into shards. Each shard builds a hierarchical navigable small-world graph by insertion:
levels drawn at random, new nodes looked up in the graph as it stands, their candidates thinned to a diverse set, links in
both directions, full lists thinned again. Graphs are stored as flat neighbour arrays, one row a shard. A query is sent to
the shards of its nearest cells, walks their graphs, and the shards' answers are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.session import cut, scratch, small_side


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable (``dim`` finite values, not all zero), and their vectors at length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    v = column.take(pa.array(rows)).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    fine = np.isfinite(v).all(1) & np.isfinite(norm) & (norm > 0)
    return rows[fine], (v[fine] / norm[fine, None]).astype(np.float32)


class FlatGraph:
    """A navigable small-world graph over unit vectors. ``levels``: from the bottom up, node numbers and their neighbours (padded with -1)."""

    def __init__(self, vectors: np.ndarray, links: int = 16, candidates: int = 32, seed: int = 7, batch: int = 512) -> None:
        self.v, self.width = vectors, 2 * links
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        height = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int), 6)
        top = 0
        while top < 6 and (height > top).sum() > 2 * links:
            top += 1
        height = np.minimum(height, top)
        height[:1] = top  # a way in from the first node on
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self._place, self._used = [], []
        for level in range(top + 1 if n else 0):
            nodes = np.flatnonzero(height >= level)
            place = np.full(n + 1, -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            self.levels.append((nodes, np.full((len(nodes), 3 * links), -1, np.int32)))
            self._place.append(place)
            self._used.append(np.zeros(len(nodes), np.int64))
        at = 0
        while at < n:  # no batch is larger than the graph it is looked up in
            to = min(n, at + min(batch, max(16, at)))
            self._insert(np.arange(at, to), height, links, candidates)
            at = to
        for level, (nodes, near) in enumerate(self.levels):
            full = np.flatnonzero(self._used[level] > self.width)
            if len(full):
                self._thin(level, full, near[full], self.width)
            self.levels[level] = (nodes, near[:, : self.width].copy())

    @classmethod
    def of(cls, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> FlatGraph:
        """A graph from its stored arrays."""
        g = cls.__new__(cls)
        g.v, g.levels, g._place = vectors, levels, []
        for nodes, _ in levels:
            place = np.full(len(vectors) + 1, -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            g._place.append(place)
        return g

    def _insert(self, new: np.ndarray, height: np.ndarray, links: int, candidates: int) -> None:
        v, before = self.v, int(new[0])
        q = v[new]
        own = q @ q.T  # nodes that come together meet here
        np.fill_diagonal(own, -3)
        ids = np.full((len(new), 0), -1)
        sims = np.zeros((len(new), 0), np.float32)
        if before:
            ids, sims = self._enter(q, before)
        for level in range(len(self.levels) - 1, -1, -1):
            if before:
                ids, sims = self._walk(q, level, ids, sims, candidates if level == 0 else 12)
            mine = np.flatnonzero(height[new] >= level)
            if not len(mine):
                continue
            among = own[np.ix_(mine, mine)]
            c = min(16, len(mine) - 1)
            near = np.argpartition(-among, c - 1, axis=1)[:, :c] if 0 < c < len(mine) - 1 else np.argsort(-among, axis=1)[:, : max(c, 0)]
            cand = np.hstack([ids[mine], new[mine][near]])
            score = np.hstack([sims[mine], np.take_along_axis(among, near, 1)]).astype(np.float32)
            score[cand < 0] = -3
            order = np.argsort(-score, axis=1, kind="stable")
            cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
            kept = self._diverse(cand, score, links)
            rows = self._place[level][new[mine]]
            links_of, used = self.levels[level][1], self._used[level]
            i, j = np.nonzero(kept)
            col = np.arange(len(i)) - np.searchsorted(i, np.arange(len(mine)))[i]
            links_of[rows[i], col] = cand[i, j]
            used[rows] = kept.sum(1)
            self._link_back(level, cand[i, j], new[mine][i])

    def _diverse(self, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling order those nearer to the node than to any kept before, filled up with the nearest of the others to half of ``most``."""
        x = self.v[cand]
        between = np.matmul(x, x.transpose(0, 2, 1))
        real = score > -2.5
        kept = np.zeros(cand.shape, bool)
        if not cand.shape[1]:
            return kept
        closest = np.full(cand.shape, -2.0, np.float32)
        count = np.zeros(len(cand), int)
        for j in range(cand.shape[1]):
            take = real[:, j] & (closest[:, j] < score[:, j]) & (count < most)
            kept[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, :, j]), closest)
        short = np.cumsum(real & ~kept, axis=1) <= np.maximum(most // 2 - count, 0)[:, None]
        return kept | (short & real)

    def _link_back(self, level: int, heads: np.ndarray, tails: np.ndarray) -> None:
        """Links from ``heads`` to ``tails``, which are new; lists that would grow too long are thinned."""
        links_of, used, place = self.levels[level][1], self._used[level], self._place[level]
        order = np.argsort(heads, kind="stable")
        rows, tails = place[heads[order]], tails[order]
        # a pair that came together may have chosen each other
        fresh = (links_of[rows] != tails[:, None]).all(1)
        rows, tails = rows[fresh], tails[fresh]
        if not len(rows):
            return
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts = np.diff(np.r_[first, len(rows)])
        turn = np.arange(len(rows)) - np.repeat(first, counts)
        room = used[rows] + np.repeat(counts, counts) <= links_of.shape[1]
        links_of[rows[room], used[rows[room]] + turn[room]] = tails[room]
        nodes = rows[first]
        fits = used[nodes] + counts <= links_of.shape[1]
        used[nodes[fits]] += counts[fits]
        if (~fits).any():
            over = nodes[~fits]
            at = np.full(len(used), -1, np.int64)
            at[over] = np.arange(len(over))
            extra = np.full((len(over), int(counts[~fits].max())), -1, np.int32)
            extra[at[rows[~room]], turn[~room]] = tails[~room]
            self._thin(level, over, np.hstack([links_of[over], extra]), self.width)

    def _thin(self, level: int, rows: np.ndarray, cand: np.ndarray, most: int) -> None:
        nodes, links_of = self.levels[level]
        for a in range(0, len(rows), 512):
            r, c = rows[a : a + 512], cand[a : a + 512]
            score = np.einsum("ij,ikj->ik", self.v[nodes[r]], self.v[c])
            score[c < 0] = -3
            order = np.argsort(-score, axis=1, kind="stable")
            c, score = np.take_along_axis(c, order, 1), np.take_along_axis(score, order, 1)
            kept = self._diverse(c, score, most)
            i, j = np.nonzero(kept)
            col = np.arange(len(i)) - np.searchsorted(i, np.arange(len(r)))[i]
            links_of[r] = -1
            links_of[r[i], col] = c[i, j]
            self._used_set(level, r, kept.sum(1))

    def _used_set(self, level: int, rows: np.ndarray, count: np.ndarray) -> None:
        self._used[level][rows] = count

    def _enter(self, queries: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of the top level, of which several are ways in: a shard may hold groups far from each other."""
        top = self.levels[-1][0]
        top = top[top < known]
        s = queries @ self.v[top].T
        best = np.argsort(-s, axis=1, kind="stable")[:, :4]
        return top[best], np.take_along_axis(s, best, 1)

    def search(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers (-1: none) and similarities of the best k for each query."""
        n, q = len(self.v), len(queries)
        if not n or not q:
            return np.full((q, k), -1), np.full((q, k), -2.0, np.float32)
        ids, sims = self._enter(queries, n)
        for level in range(len(self.levels) - 1, -1, -1):
            ids, sims = self._walk(queries, level, ids, sims, max(beam, k) if level == 0 else 12)
        if ids.shape[1] < k:
            pad = k - ids.shape[1]
            ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
        return ids[:, :k], sims[:, :k]

    def _walk(self, queries: np.ndarray, level: int, ids: np.ndarray, sims: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        links, place = self.levels[level][1], self._place[level]
        q = len(queries)
        seen = np.zeros((q, len(self.v) + 1), bool)
        seen[:, -1] = True  # the padding's place
        latest = np.empty(seen.shape, np.int32)
        np.put_along_axis(seen, ids, True, 1)
        width = ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, max(0, beam - width))), constant_values=-1)[:, :beam]
        sims = np.pad(sims, ((0, 0), (0, max(0, beam - width))), constant_values=-2)[:, :beam]
        done = ids < 0
        active = np.arange(q)
        while len(active):
            a_ids, a_sims, a_done = ids[active], sims[active], done[active]
            rank = np.where(a_done, -3, a_sims)
            pick = np.argsort(-rank, axis=1, kind="stable")[:, :step]
            open_ = np.take_along_axis(rank, pick, 1) > -2.5
            np.put_along_axis(a_done, pick, True, 1)
            done[active] = a_done
            from_ = np.where(open_, np.take_along_axis(a_ids, pick, 1), -1)
            at = place[from_]
            fresh = np.where((at >= 0)[..., None], links[at], -1).reshape(len(active), -1)
            row = np.repeat(np.arange(len(active)), fresh.shape[1])
            flat = fresh.ravel()
            new = ~seen[active[row], flat]
            row, flat = row[new], flat[new]
            turn = np.arange(len(row), dtype=np.int32)
            latest[active[row], flat] = turn  # of a node that several offer one stays
            one = latest[active[row], flat] == turn
            row, flat = row[one], flat[one]
            seen[active[row], flat] = True
            if len(row):
                s = np.einsum("ij,ij->i", queries[active[row]], self.v[flat])
                good = s > a_sims[row, -1]
                row, flat, s = row[good], flat[good], s[good]
            if len(row):
                start = np.searchsorted(row, np.arange(len(active)))
                col = np.arange(len(row)) - start[row]
                more = int(col.max()) + 1
                x_ids, x_sims = np.full((len(active), more), -1, a_ids.dtype), np.full((len(active), more), -2, np.float32)
                x_ids[row, col], x_sims[row, col] = flat, s
                all_ids, all_sims = np.hstack([a_ids, x_ids]), np.hstack([a_sims, x_sims])
                all_done = np.hstack([a_done, x_ids < 0])
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[active], sims[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
                done[active] = np.take_along_axis(all_done, order, 1)
            active = active[(~done[active]).any(1)]
        return ids, sims


def _centroids(sample: np.ndarray, k: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 0):
        near = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(sample), 4096)])
        for i in range(k):
            own = sample[near == i]
            if len(own):
                m = own.mean(0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


class Cells:
    """Centroids in one level (``coarse`` None) or two: ``fine`` and, of each, the coarse cell that it splits."""

    def __init__(self, fine: np.ndarray, coarse: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        self.fine, self.coarse = fine, coarse
        self.parts = [np.flatnonzero(of == j) for j in range(len(coarse))] if coarse is not None else []

    def probes(self, least: int) -> int:
        """Cells that a query goes to: ``least``, and two more for each doubling of the cells beyond that."""
        return min(len(self.fine), least + math.ceil(2 * math.log2(max(1.0, len(self.fine) / least))))

    def nearest(self, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: of each row of ``x`` the ``w`` nearest cells; in two levels those of the nearest coarse cells."""
        if self.coarse is None:
            return _top(np.arange(len(x)), x @ self.fine.T, np.arange(len(self.fine)), w, len(x))
        rows, coarse = _top(np.arange(len(x)), x @ self.coarse.T, np.arange(len(self.coarse)), 1 if w == 1 else w, len(x))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in np.unique(coarse):
            own, part = rows[coarse == j], self.parts[j]
            if len(part):
                s = x[own] @ self.fine[part].T
                found.append((np.repeat(own, len(part)), np.tile(part, len(own)), s.ravel()))
        row, cell, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-sim, row))
        row, cell = row[order], cell[order]
        first = np.searchsorted(row, np.arange(len(x)))
        keep = np.arange(len(row)) - first[row] < w
        return row[keep], cell[keep]


def _top(rows: np.ndarray, s: np.ndarray, names: np.ndarray, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    w = min(w, s.shape[1])
    best = np.argpartition(-s, w - 1, axis=1)[:, :w] if w < s.shape[1] else np.tile(np.arange(s.shape[1]), (n, 1))
    return np.repeat(rows, w), names[best.ravel()]


class VectorIndex:
    """Stored graphs under ``path``: ``centres`` and ``shards``, one row of flat arrays each. Built once by build, asked many times."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 64, shard_rows: int = 8192, sample_rows: int = 40_000, flat_cells: int = 1000, most_cells: int = 200_000) -> None:
        self.spark, self.path, self.dim, self.shard_rows, self.sample_rows, self.flat_cells, self.most_cells = spark, path, dim, shard_rows, sample_rows, flat_cells, most_cells

    def _place(self, cells: dict[str, Cells], least: int | None, kind: str = "f4", count: bool = False):
        """Each usable vector to its nearest cell, or, as a query, to several; with ``count`` only how many go to each cell."""
        sent, dim = self.spark.sparkContext.broadcast(cells), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, v = unit_rows(batch["vec"], dim)
                tbl = np.array(batch["tbl"].to_pylist(), object)[rows]
                ids = batch["id"].take(pa.array(rows))
                for name in sorted(set(tbl) & set(sent.value)):
                    own = np.flatnonzero(tbl == name)
                    at, cell = sent.value[name].nearest(v[own], 1 if least is None else sent.value[name].probes(least))
                    if count:
                        met, n = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(met)), pa.array(met.astype(np.int32)), pa.array(n.astype(np.int64))], names=["tbl", "cell", "n"])
                        continue
                    flat = np.ascontiguousarray(v[own], dtype=kind)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.itemsize * dim), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())
                    rep = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rep)), pa.array(cell.astype(np.int32)), ids.take(pa.array(own)).take(rep), raw.take(rep)], names=["tbl", "cell", "id", "raw"])

        return run

    def _sample(self, src: DataFrame, tbl: str, n: int) -> np.ndarray:
        every = max(1, math.ceil(n / self.sample_rows))
        part = src.where((F.col("tbl") == tbl) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).select("vec").limit(2 * self.sample_rows).toArrow()
        return unit_rows(part["vec"], self.dim)[1]

    def build(self, vectors: DataFrame) -> VectorIndex:
        """Indexes all usable vectors of ``vectors`` (``tbl``, ``id``, ``vec``). Only the centroids rest on samples, of at most ``2 * sample_rows`` vectors a table, or a coarse cell."""
        dim, shard_rows = self.dim, self.shard_rows
        src = vectors.select("tbl", "id", "vec").where("vec is not null and id is not null")
        counts = {r.tbl: r.n for r in src.groupBy("tbl").agg(F.count("*").alias("n")).collect()}
        cells: dict[str, Cells] = {}
        deep: dict[str, Cells] = {}
        for tbl, n in counts.items():
            want = max(1, round(n / shard_rows * 1.3))
            if want > self.most_cells:
                raise ValueError(f"{want} cells; at most {self.most_cells} centroids are sent to the workers: raise shard_rows")
            sample = self._sample(src, tbl, n) if want > 1 else np.zeros((0, dim), np.float32)
            two = want > self.flat_cells
            k = min(math.ceil(math.sqrt(want)) if two else want, max(1, len(sample) // 10))
            cells[tbl] = Cells(_centroids(sample, k) if len(sample) else np.zeros((1, dim), np.float32))
            if two:
                deep[tbl] = cells[tbl]
        if deep:
            cells |= self._split(src, deep, counts)
        rows = [(tbl, i, bytes(f.tobytes()), None) for tbl, c in cells.items() for i, f in enumerate(c.fine)] + [(tbl, i, bytes(f.tobytes()), c.parts[i].tolist()) for tbl, c in cells.items() if c.coarse is not None for i, f in enumerate(c.coarse)]
        self.spark.createDataFrame(rows, "tbl string, cell int, centre binary, parts array<int>").write.mode("overwrite").parquet(f"{self.path}/centres")
        placed = cut(src.mapInArrow(self._place(cells, None), "tbl string, cell int, id string, raw binary"))
        sizes = placed.groupBy("tbl", "cell").agg(F.count("*").alias("n"))
        splits = small_side(sizes.select("tbl", "cell", F.ceil(F.col("n") / (2 * shard_rows)).cast("int").alias("splits")))
        indexed = placed.join(splits, ["tbl", "cell"]).withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))

        def graph(key: tuple, x: pa.Table) -> pa.Table:
            ids, first = np.unique(np.array(x["id"].to_pylist(), object).astype(str), return_index=True)  # an id stored twice counts once
            v = np.frombuffer(b"".join(x["raw"].to_pylist()), np.float32).reshape(-1, dim)[first]
            g = FlatGraph(v)
            levels = [{"nodes": nodes.astype(np.int32).tobytes(), "links": near.astype(np.int32).tobytes(), "width": near.shape[1]} for nodes, near in g.levels]
            row = {"tbl": [key[0].as_py()], "cell": [key[1].as_py()], "split": [key[2].as_py()], "splits": [key[3].as_py()], "ids": [ids.tolist()], "raw": [v.tobytes()], "levels": [levels]}
            level = pa.struct([("nodes", pa.binary()), ("links", pa.binary()), ("width", pa.int32())])
            return pa.table(row, schema=pa.schema([("tbl", pa.string()), ("cell", pa.int32()), ("split", pa.int32()), ("splits", pa.int32()), ("ids", pa.list_(pa.string())), ("raw", pa.binary()), ("levels", pa.list_(level))]))

        schema = "tbl string, cell int, split int, splits int, ids array<string>, raw binary, levels array<struct<nodes: binary, links: binary, width: int>>"
        indexed.groupBy("tbl", "cell", "split", "splits").applyInArrow(graph, schema).write.mode("overwrite").parquet(f"{self.path}/shards")
        return self

    def _split(self, src: DataFrame, coarse: dict[str, Cells], counts: dict[str, int]) -> dict[str, Cells]:
        """Coarse cells split into fine ones, each by a sample of its own vectors, on the workers."""
        dim, sample_rows, shard_rows, floor = self.dim, self.sample_rows, self.shard_rows, {t: len(c.fine) for t, c in coarse.items()}
        placed = cut(src.where(F.col("tbl").isin(*coarse)).mapInArrow(self._place(coarse, None), "tbl string, cell int, id string, raw binary"))
        sizes = placed.groupBy("tbl", "cell").agg(F.count("*").alias("n"))
        part = placed.join(small_side(sizes), ["tbl", "cell"]).where(F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / sample_rows)) == 0)

        def fit(key: tuple, x: pa.Table) -> pa.Table:
            v = np.frombuffer(b"".join(x["raw"].to_pylist()), np.float32).reshape(-1, dim)
            c = _centroids(v, min(max(1, round(x["n"][0].as_py() / shard_rows * 1.3)), len(v)))
            return pa.table({"tbl": [key[0].as_py()] * len(c), "cell": pa.array([key[1].as_py()] * len(c), pa.int32()), "centre": [r.tobytes() for r in c]})

        fine = part.groupBy("tbl", "cell").applyInArrow(fit, "tbl string, cell int, centre binary").toPandas()  # at most most_cells, twice as many with rounding
        out = {}
        for tbl in floor:
            own = fine[fine["tbl"] == tbl].sort_values("cell", kind="stable")
            out[tbl] = Cells(np.stack([np.frombuffer(b, np.float32) for b in own["centre"]]), coarse[tbl].fine, own["cell"].to_numpy())
        return out

    def cells(self) -> dict[str, Cells]:
        out = {}
        rows = self.spark.read.parquet(f"{self.path}/centres").toPandas()
        for tbl, own in rows.sort_values("cell", kind="stable").groupby("tbl"):
            stack = lambda d: np.stack([np.frombuffer(b, np.float32) for b in d["centre"]])
            fine, coarse = own[own["parts"].isna()], own[~own["parts"].isna()]
            of = np.zeros(len(fine), int)
            for i, part in enumerate(coarse["parts"]):
                of[np.asarray(part, int)] = i
            out[tbl] = Cells(stack(fine), stack(coarse), of) if len(coarse) else Cells(stack(fine))
        return out

    def search(self, queries: DataFrame, k: int = 10, cells_probed: int = 12, beam: int = 96, query_type: str = "f4", query_rows: int = 50_000) -> DataFrame:
        """The ``k`` most similar other vectors of ``queries`` (``tbl``, ``id``, ``vec``): ``tbl``, ``id``, ``neighbour_id``, ``sim``; see nearest."""
        dim = self.dim
        shards = self.spark.read.parquet(f"{self.path}/shards")
        cells, queries = self.cells(), queries.dropDuplicates(["tbl", "id"])
        asked = queries.mapInArrow(self._place(cells, cells_probed, query_type), "tbl string, cell int, id string, raw binary")
        # the queries of a cell in parts of about query_rows, each of which meets the cell's shards
        sizes = queries.mapInArrow(self._place(cells, cells_probed, count=True), "tbl string, cell int, n bigint").groupBy("tbl", "cell")
        parts = cut(sizes.agg(F.ceil(F.sum("n") / query_rows).cast("int").alias("parts")))
        whole = small_side(shards.select("tbl", "cell", "splits").distinct().join(parts, ["tbl", "cell"]))
        asked = asked.join(whole, ["tbl", "cell"]).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
        met = shards.join(whole.drop("splits"), ["tbl", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["tbl", "cell", "split", "part"]

        def answer(q: pa.Table, x: pa.Table) -> pa.Table:
            out: list[pa.Table] = []
            fields = [("tbl", pa.string()), ("id", pa.string()), ("neighbour_id", pa.string()), ("sim", pa.float32())]
            if len(q) and len(x):
                ids = np.array(x["ids"][0].as_py(), object).astype(str)
                levels = [(np.frombuffer(m["nodes"], np.int32).astype(np.int64), np.frombuffer(m["links"], np.int32).reshape(-1, m["width"])) for m in x["levels"][0].as_py()]
                graph = FlatGraph.of(np.frombuffer(x["raw"][0].as_py(), np.float32).reshape(-1, dim), levels)
                names, tbl = np.array(q["id"].to_pylist(), object).astype(str), q["tbl"][0].as_py()
                asked_v = np.frombuffer(b"".join(q["raw"].to_pylist()), query_type).reshape(-1, dim).astype(np.float32)
                for a in range(0, len(names), 1024):
                    near, sim = graph.search(asked_v[a : a + 1024], k + 1, beam)
                    i, j = np.nonzero(near >= 0)
                    who, whom = names[a + i], ids[near[i, j]]
                    other = who != whom
                    out.append(pa.table({"tbl": pa.array([tbl] * int(other.sum()), pa.string()), "id": pa.array(who[other].tolist(), pa.string()), "neighbour_id": pa.array(whom[other].tolist(), pa.string()), "sim": pa.array(sim[i, j][other], pa.float32())}))
            return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in fields})

        found = asked.select(*keys, "id", "raw").groupBy(*keys).cogroup(met.select(*keys, "ids", "raw", "levels").groupBy(*keys)).applyInArrow(answer, "tbl string, id string, neighbour_id string, sim float")
        w = Window.partitionBy("tbl", "id").orderBy(F.desc("sim"), "neighbour_id")
        return found.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")


def nearest(
    vectors: DataFrame, probes: DataFrame | None, k: int = 10, dim: int = 64, shard_rows: int = 8192, cells_probed: int = 12, beam: int = 96, sample_rows: int = 40_000, query_type: str = "f4", flat_cells: int = 1000
) -> DataFrame:
    """The ``k`` most similar other vectors for each probe, by an index built for this call and kept in the shared folder.

    ``vectors``: ``tbl``, ``id``, ``vec`` (array<float>); only vectors of one ``tbl``, of which there are few, are compared. ``probes``:
    ``tbl`` and ``id`` of vectors; None: every vector. Returns ``tbl``, ``id``, ``neighbour_id``, ``sim`` (cosine).

    Vectors that are null, of another length, with a null or non-finite value or all zero are left out, as probes too. An id
    stored twice counts once; ties go to the smaller id. Fewer than ``k`` others give fewer rows, an empty input none. Only
    the centroids rest on samples (``sample_rows``); all vectors are indexed. A query goes to ``cells_probed`` cells, and to two
    more for each doubling of their number beyond that; neighbours in other cells are missed. ``query_type`` is the
    precision in which queries travel to the shards (``f2`` halves what is shuffled when every vector is a query).
    """
    spark = vectors.sparkSession
    index = VectorIndex(spark, scratch(spark, "vectors"), dim, shard_rows, sample_rows, flat_cells).build(vectors)
    src = vectors.select("tbl", "id", "vec").where("vec is not null and id is not null")
    return index.search(src if probes is None else src.join(probes.select("tbl", "id").distinct(), ["tbl", "id"], "left_semi"), k, cells_probed, beam, query_type)
