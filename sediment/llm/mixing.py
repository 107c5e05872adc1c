"""Sources mixed to target shares of tokens.

Targets become whole numbers of equal blocks of tokens by the Sainte-Lague method: the next block goes to the source with the
highest quotient of its share by 2 * blocks + 1, as long as its capacity (its tokens times the repeats allowed) lasts. A
source's blocks are dealt to its shards in the same way, so that each shard has a whole number of them as its quota; there
are always many more blocks than shards. In a shard the documents are put into a seeded order, round after round, and taken
up to the shard's quota.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seats_of(weights: Sequence[float], seats: int, capacity: Sequence[int]) -> np.ndarray:
    """``seats`` dealt by highest quotients weight / (2 * seats so far + 1); none above its capacity; ties to the earlier place. Weights of zero get none.

    All seats whose quotient lies above a level are dealt at once, the level found by halving; the few that are left go one by one.
    """
    w, cap = np.asarray(weights, float), np.asarray(capacity, np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    if not len(w) or cap.sum() <= seats:
        return cap
    # the number of odd divisors d with w / d > level
    above = lambda level: np.minimum(np.floor(np.minimum((w / level + 1) / 2, 2.0**62)).astype(np.int64), cap)
    high, low = float(w.max()) * 2, float(w.max()) / (2.0 * seats + 2)
    while above(low).sum() < seats:
        low /= 2
    for _ in range(100):
        mid = (high + low) / 2
        if above(mid).sum() <= seats - 1:
            high = mid
        else:
            low = mid
    got = above(high)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < cap)]
    heapq.heapify(heap)
    for _ in range(int(seats - got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def sainte_lague(weights: Mapping[str, float], seats: int, capacity: Mapping[str, int]) -> dict[str, int]:
    """seats_of by name; ties by name."""
    names = sorted(weights)
    got = seats_of([weights[k] for k in names], seats, [capacity.get(k, 0) for k in names])
    return {k: int(n) for k, n in zip(names, got, strict=True)}


_ENCODINGS: dict[str, Any] = {}


def _encoding(ranks: bytes, pattern: str):
    """The tokenizer of a vocabulary of ranks; kept by the worker process, as building it takes longer than many a batch."""
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest() + pattern
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, max_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``n_tokens`` in place of ``text``: whole texts through a byte-pair vocabulary of ranks. A null text has 0; a column named ``n_tokens`` is replaced.

    The vocabulary is read by the driver and sent to the workers; one of more than ``max_bytes`` is refused.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_tokens")]
    with open(ranks_path, "rb") as f:
        ranks = f.read(max_bytes + 1)
    if len(ranks) > max_bytes:
        raise ValueError(f"the vocabulary has more than {max_bytes} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value, pattern)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))


def mix(sized: DataFrame, targets: DataFrame, blocks: int = 10_000, shard_tokens: int = 50_000_000, shard_blocks: int = 100, seed: int = 42) -> DataFrame:
    """How often each document is used.

    ``sized``: ``id``, ``source`` and ``n_tokens``; ``targets``: ``source_name``, ``target_share`` and ``max_repeats``, a bounded list.
    The mix is as large as the scarcest source allows at its share. Returns ``id``, ``source``, ``n_tokens`` and ``times``.

    A source has as many shards as its tokens need, none of more than about ``shard_tokens``; there are at least ``blocks`` blocks, and
    at least ``shard_blocks`` for each shard, so that a block is always a small part of a shard. Documents stay whole: a quota is met
    to within half a document a shard.

    Sources without a target, documents without tokens and targets without documents or share contribute nothing; the other
    shares are then taken of what remains. Null sources match no target. Repeated targets add up. An empty input gives an
    empty mix. Columns of other names are ignored.
    """
    spark = sized.sparkSession
    sized = sized.select("id", F.lower(F.trim("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0 and source is not null")
    goal = {r.s: (r.w, r.m) for r in targets.groupBy(F.lower(F.trim("source_name")).alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")).collect() if r.s and (r.w or 0) > 0 and (r.m or 0) > 0}
    sized = sized.where(F.col("source").isin(*goal)) if goal else sized.limit(0)
    totals = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # as many as targets
    if not totals:
        return spark.createDataFrame([], "id bigint, source string, n_tokens bigint, times int")
    share = {s: goal[s][0] for s in totals}
    room = {s: totals[s] * goal[s][1] for s in totals}
    whole = min(room[s] / share[s] for s in totals) * sum(share.values())
    # shards: by a seeded hash
    shards = {s: max(1, -(-n // shard_tokens)) for s, n in totals.items()}
    blocks = max(blocks, shard_blocks * sum(shards.values()))
    block = max(1.0, whole / blocks)
    seats = sainte_lague(share, int(whole / block + 1e-9), {s: int(room[s] / block + 1e-9) for s in totals})
    lookup = lambda d, kind: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("source")).cast(kind)
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), lookup(shards, "int")).cast("int"))
    per_shard = sized.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).toPandas()  # numbers only, tokens / shard_tokens of them
    quotas = []
    for s, own in per_shard.sort_values(["source", "shard"]).groupby("source"):
        n = own["n"].to_numpy()
        dealt = seats_of(n, seats[s], np.floor(n * goal[s][1] / block + 1e-9).astype(np.int64))
        left = int(seats[s] - dealt.sum())  # what rounding leaves of the shards' room goes to the largest
        dealt[np.argsort(-n, kind="stable")[: max(left, 0)]] += 1
        quotas += [(s, int(k), float(v) * block, int(t), int(goal[s][1])) for k, v, t in zip(own["shard"], dealt, n, strict=True)]
    q = spark.createDataFrame(quotas, "source string, shard int, quota double, all bigint, most int")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    d = sized.join(F.broadcast(q) if len(quotas) <= 200_000 else q, ["source", "shard"]).withColumn("after", F.sum("n_tokens").over(w))
    # full rounds, and in the last one those documents whose middle lies inside what is left of the quota
    rounds = F.least(F.floor(F.col("quota") / F.col("all")), F.col("most"))
    last = (F.col("after") - F.col("n_tokens") / 2 <= F.col("quota") - rounds * F.col("all")).cast("int")
    return d.select("id", "source", "n_tokens", F.least(rounds + last, F.col("most")).cast("int").alias("times")).where("times > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Report: of each source its target and actual share, documents, tokens and the most repeats."""
    t = targets.groupBy(F.lower(F.trim("source_name")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    m = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"), F.max("times").alias("max_times"))
    out = t.join(F.broadcast(m), "source", "left").fillna(0, ["n_docs", "n_tokens", "max_times"])
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))
