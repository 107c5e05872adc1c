"""Exact nearest vectors for a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.vectors import unit, usable


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, block: int = 20_000) -> DataFrame:
    """``vectors``: ``id`` (bigint), ``vec``; ``queries``: ``qid`` (bigint), ``vec``. The ``k`` of highest cosine for each query but the vector of its own id: ``qid``, ``id``, ``score``, ``pos``.

    Queries are taken in blocks of ``block``; each batch of vectors gives its best ``k`` for a query by one matrix product, then
    those are merged. Unusable vectors and queries are left out. Ties go to the smaller id.
    """
    q = queries.where(usable(F.col("vec"), dim)).select("qid", unit(F.col("vec")).alias("vec"))
    v = vectors.where(usable(F.col("vec"), dim)).select("id", unit(F.col("vec")).alias("vec"))
    spark, out = vectors.sparkSession, None
    n_blocks = max(1, -(-q.count() // block))
    for b in range(n_blocks):
        part = q.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).toArrow()  # about block rows
        qids = part["qid"].to_numpy()
        mat = part["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(qids) else np.zeros((0, dim))
        sent = spark.sparkContext.broadcast((qids, mat))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, m = sent.value
            for batch in batches:
                if not len(own) or not batch.num_rows:
                    continue
                ids = batch["id"].to_numpy()
                x = batch["vec"].flatten().to_numpy().reshape(-1, dim)
                s = m @ x.T
                s[own[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k] if s.shape[1] <= 4 * k else None
                if order is None:
                    c = np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(-s <= c)  # all ties with the k-th are kept for the merge
                else:
                    i, j = np.repeat(np.arange(len(own)), order.shape[1]), order.ravel()
                good = s[i, j] > -1.5
                i, j = i[good], j[good]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["qid", "id", "score"])

        found = v.mapInArrow(run, "qid bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def needs_expansion(top: DataFrame) -> DataFrame:
    """``qid``, ``expand``: at least five hits and the lead of the first over the second is less than twice that of the second over the fifth."""
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("score")))
    t = top.groupBy("qid").agg(at(1).alias("s1"), at(2).alias("s2"), at(5).alias("s5"))
    return t.select("qid", F.coalesce((F.col("s1") - F.col("s2")) < 2 * (F.col("s2") - F.col("s5")), F.lit(False)).alias("expand"))


def multi_probe(vectors: DataFrame, queries: DataFrame, k: int, dim: int, probes: int = 3) -> DataFrame:
    """exact_top_k, widened: the first ``probes`` answers are asked for in turn, their answers count 0.5 / place; the best score of each id stays."""
    base = exact_top_k(vectors, queries, k, dim)
    first = base.where(F.col("pos") <= probes).select("qid", F.col("id").alias("via"), "pos")
    asked = first.select("via").distinct().join(vectors.withColumnRenamed("id", "via"), "via").select(F.col("via").alias("qid"), "vec")
    more = exact_top_k(vectors, asked, k, dim).select(F.col("qid").alias("via"), "id", "score")
    more = first.join(more, "via").where("id <> qid").select("qid", "id", (F.col("score") * 0.5 / F.col("pos")).alias("score"))
    both = base.select("qid", "id", "score").unionByName(more).groupBy("qid", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
