"""Lexical ranking: postings and BM25 in three variants, many queries at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.text import WORD, tokens
from sediment.session import cut, small_side


def postings(docs: DataFrame, tokenise: Callable[[Column], Column] = tokens, only: DataFrame | None = None) -> DataFrame:
    """``docs``: ``id``, ``text``. One row for each document and term: ``id``, ``term``, ``tf``, ``dl``. With ``only`` (``term``, small) for these terms alone.
    Texts without terms have none; nulls count as empty."""
    toks = docs.select("id", tokenise(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = toks.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, tokenise: Callable[[Column], Column] = tokens) -> DataFrame:
    """In one pass ``term`` and ``df``; the row of the null term has the number of documents as ``df`` and all tokens as ``total``."""
    toks = docs.select(tokenise(F.coalesce("text", F.lit(""))).alias("_t"))
    none = F.struct(F.lit(None).cast("string").alias("term"), F.size("_t").alias("dl"))
    each = F.transform(F.array_distinct("_t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("dl")))
    return toks.select(F.explode(F.array_append(each, none)).alias("x")).groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.dl").alias("total"))


class Matched:
    """What BM25 needs of ``docs`` for ``queries``, from one pass that takes each text apart once: of every document its length and those of its terms that a query has.

    ``docs``: ``id``, ``text`` and columns to ``keep``; ``queries``: ``qid``, ``text``. Documents without a term of a query only count for the mean length.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, tokenise: Callable[[Column], Column] = tokens, keep: tuple[str, ...] = (), most_literals: int = 5000) -> None:
        self.docs, self.tokenise, self.keep = docs, tokenise, keep
        self.asked = cut(queries.select("qid", F.explode(tokenise(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")))
        names = [r[0] for r in self.asked.select("term").distinct().limit(most_literals + 1).collect()]
        toks = tokenise(F.coalesce("text", F.lit("")))
        if len(names) <= most_literals:  # the same terms as a set inside the pass
            split = F.transform(F.array(toks), lambda a: F.struct(F.size(a).alias("dl"), F.filter(a, lambda x: x.isin(names) if names else F.lit(False)).alias("hits")))[0]
            rows = cut(docs.select("id", *keep, split.alias("s")).select("id", *keep, "s.*"))
            self.lengths = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
            post = rows.where(F.size("hits") > 0).select("id", *keep, "dl", F.explode("hits").alias("term"))
        else:
            rows = cut(docs.select("id", *keep, toks.alias("t")).select("id", *keep, F.size("t").alias("dl"), F.explode_outer("t").alias("term")).groupBy("id", *keep, "dl", "term").agg(F.count("*").alias("tf")))
            each = rows.groupBy("id").agg(F.max("dl").alias("dl"))
            self.lengths = each.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
            post = rows.join(small_side(self.asked.select("term").distinct()), "term", "left_semi").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("tf").cast("int")))).drop("_i", "tf")
        self.postings = post.groupBy("id", *keep, "dl", "term").agg(F.count("*").alias("tf"))
        whole = self.lengths.first()
        self.n_docs, self.avgdl = whole.n, max((whole.total or 0) / max(whole.n, 1), 1e-9)
        self.df = cut(self.postings.groupBy("term").agg(F.count("*").alias("df")))

    def _idf(self, variant: str) -> Column:
        df, n = F.col("df"), F.lit(float(self.n_docs))
        if variant == "plus":
            return F.log((n + 1) / df)
        if variant == "fts":
            return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        raw = lambda df: F.log(n - df + 0.5) - F.log(df + 0.5)
        if not self.df.where(raw(F.col("df")) < 0).take(1):
            return raw(F.col("df"))
        # a term of most documents gets a quarter of the mean over all terms: only then all are counted
        mean = term_stats(self.docs, self.tokenise).where("term is not null").agg(F.avg(raw(F.col("df")))).first()[0]
        return F.when(raw(F.col("df")) < 0, F.lit((mean or 0.0) * 0.25)).otherwise(raw(F.col("df")))

    def score(self, variant: str = "okapi") -> DataFrame:
        """``qid``, ``id``, what was kept, and ``score``; see bm25."""
        k1, b = (1.2 if variant == "fts" else 1.5), 0.75
        asked = self.asked.join(self.df.select("term", self._idf(variant).alias("idf")), "term")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / self.avgdl))
        return self.postings.join(small_side(asked), "term").groupBy("qid", "id", *self.keep).agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, variant: str = "okapi", tokenise: Callable[[Column], Column] = tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """BM25 scores: ``qid``, ``id``, ``score`` for documents that share a term with the query.

    ``docs``: ``id``, ``text``; ``queries``: ``qid``, ``text``. ``okapi``: k1 1.5, b 0.75, negative idf replaced by a quarter of the mean idf;
    ``plus``: idf ln((N + 1) / n), same k1 and b; ``fts``: k1 1.2. A query's repeated terms count repeatedly. The mean length
    counts empty documents. Null texts are empty; empty documents, queries or tables give no rows. For several variants see Matched.
    """
    return Matched(docs, queries, tokenise, keep).score(variant)


def top_k(scores: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The best ``k`` of each group, ties to the smaller ``tie``; adds ``pos`` from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def bm25_many(docs: DataFrame, queries: DataFrame, k: int, variant: str = "okapi", most_cells: int = 10_000_000, most_terms: int = 2_000_000) -> DataFrame:
    """The best ``k`` documents (``id`` bigint) for each of many long queries (``qid`` int): ``qid``, ``id``, ``score``, ``pos``; as bm25 with top_k.

    The texts are taken apart once, into sparse rows of the queries' terms (at most ``most_terms``), from which terms are counted and documents scored.
    Queries are held as a matrix of at most ``most_cells`` weights, in blocks if there are more: the terms' weights in a batch of documents times the
    matrix are all its scores, and a task keeps only the best ``k`` of each query.
    """
    k1, b = (1.2 if variant == "fts" else 1.5), 0.75
    spark = docs.sparkSession
    asked = cut(queries.select("qid", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    names = sorted(r[0] for r in asked.select("term").distinct().limit(most_terms + 1).collect())
    if len(names) > most_terms:
        raise ValueError(f"more than {most_terms} terms in the queries")
    known = spark.sparkContext.broadcast({n: i for i, n in enumerate(names)})

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, code = regex.compile(WORD), known.value
        for batch in batches:
            dl, codes, tfs = [], [], []
            for t in batch["text"].to_pylist():
                found = word.findall(t.lower()) if t else []
                hits = Counter(map(code.get, found))
                hits.pop(None, None)
                dl.append(len(found)), codes.append(list(hits)), tfs.append(list(hits.values()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(dl, pa.int32()), pa.array(codes, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["id", "dl", "codes", "tfs"])

    rows = cut(docs.select("id", "text").mapInArrow(apart, "id bigint, dl int, codes array<int>, tfs array<int>"))
    whole = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
    n_docs, avgdl = whole.n, max((whole.total or 0) / max(whole.n, 1), 1e-9)
    found = rows.select(F.explode("codes").alias("c")).groupBy("c").agg(F.count("*").alias("df")).toPandas()  # at most most_terms
    df = np.zeros(len(names))
    df[found["c"].to_numpy(int)] = found["df"].to_numpy()
    with np.errstate(divide="ignore"):
        if variant == "plus":
            idf = np.log((n_docs + 1) / df)
        elif variant == "fts":
            idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 1e-6)
        else:
            idf = np.log(n_docs - df + 0.5) - np.log(df + 0.5)
            if (idf[df > 0] < 0).any():
                d = F.col("df")
                mean = term_stats(docs).where("term is not null").agg(F.avg(F.log(F.lit(float(n_docs)) - d + 0.5) - F.log(d + 0.5))).first()[0]
                idf[idf < 0] = (mean or 0.0) * 0.25
    idf[df == 0] = 0
    n_queries = asked.select("qid").distinct().count()
    blocks, out = max(1, -(-n_queries * len(names) // most_cells)), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toPandas()  # about most_cells / terms queries
        part["c"] = part["term"].map(known.value)
        part = part[df[part["c"].to_numpy(int)] > 0]
        qids, row = np.unique(part["qid"].to_numpy(), return_inverse=True)
        used, col = np.unique(part["c"].to_numpy(int), return_inverse=True)
        weight = np.zeros((len(used), len(qids)))
        weight[col, row] = part["qtf"].to_numpy() * idf[used[col]]
        shared = np.zeros(weight.shape, np.float32)
        shared[col, row] = 1
        place = np.full(len(names), -1)
        place[used] = np.arange(len(used))
        sent = spark.sparkContext.broadcast((qids, place, weight, shared))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, place, weight, shared = sent.value
            best_s, best_i = np.full((len(qids), 0), -np.inf), np.zeros((len(qids), 0), np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    ids, dl = part["id"].to_numpy(zero_copy_only=False), part["dl"].to_numpy()
                    doc = np.repeat(np.arange(len(ids)), part["codes"].value_lengths().to_numpy(zero_copy_only=False))
                    at, n = place[part["codes"].flatten().to_numpy()], part["tfs"].flatten().to_numpy()
                    doc, at, n = doc[at >= 0], at[at >= 0], n[at >= 0]
                    share, has = np.zeros((len(ids), len(weight))), np.zeros((len(ids), len(weight)), np.float32)
                    share[doc, at] = n * (k1 + 1) / (n + k1 * (1 - b + b * dl[doc] / avgdl))
                    has[doc, at] = 1
                    s = share @ weight
                    s[(has @ shared) == 0] = -np.inf
                    s = s.T
                    if s.shape[1] > 4 * k:  # all ties with the k-th stay for the merge
                        rounded = np.round(s, 9)
                        least = np.partition(rounded, -k, axis=1)[:, -k]
                        i, j = np.nonzero((rounded >= least[:, None]) & np.isfinite(s))
                        width = int(np.bincount(i, minlength=len(qids)).max()) if len(i) else 0
                        few_s, few_i = np.full((len(qids), width), -np.inf), np.zeros((len(qids), width), np.int64)
                        col = np.arange(len(i)) - np.searchsorted(i, np.arange(len(qids)))[i]
                        few_s[i, col], few_i[i, col] = s[i, j], ids[j]
                    else:
                        few_s, few_i = s, np.broadcast_to(ids, s.shape)
                    s, own = np.hstack([best_s, few_s]), np.hstack([best_i, few_i])
                    order = np.lexsort((own, -np.round(s, 9)), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
            i, j = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(qids[i].astype(np.int32)), pa.array(best_i[i, j]), pa.array(best_s[i, j])], names=["qid", "id", "score"])

        found = rows.mapInArrow(run, "qid int, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out.withColumn("score", F.round("score", 9)), k)
