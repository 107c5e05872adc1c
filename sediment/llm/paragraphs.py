"""Paragraphs that are nearly the same in several records, and which of them to remove.

A paragraph's words make shingles of five; its MinHash signature is cut into bands. Equal paragraphs are one from the start.
Different ones that share a band's key are compared by the exact Jaccard similarity of their shingles, taken from the text:
all of a bucket with each other, a large one in parts, as ``n_links`` counts every link. Only pairs whose sizes rule out the similarity are spared.
Links make classes by components, and of a class the first paragraph stays. ``bands`` and ``rows`` are tuned for recall: at a similarity of 0.8, eight
bands of three rows meet with a probability of 1 - (1 - 0.8 ** 3) ** 8 = 0.997, equal ones always.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.spans import _mix
from sediment.operators.components import components
from sediment.session import cut, kept

#: What parts paragraphs, and words.
BREAK, WORD = re.compile(r"\n\s*\n"), re.compile(r"\w+")


def split(text: str) -> list[tuple[int, int]]:
    """Start and end of each paragraph that has a word."""
    out, at = [], 0
    for m in [*BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if WORD.search(text, at, end):
            out.append((at, end))
        at = m.end() if m else end
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], size: int = 5) -> list[str]:
    """Runs of ``size`` words, of fewer where there are no more; different ones, sorted."""
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _minima(ws: list[list[str]], size: int, seeds: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """Of each list of words the least hash of its shingles under each seed."""
    flat = np.array([known[x] if x in known else known.setdefault(x, hash_of(x)) for one in ws for x in [*one, *[""] * (size - 1)]], np.uint64)
    n = np.array([len(one) for one in ws])
    first = np.r_[0, np.cumsum(n + size - 1)[:-1]]
    count = np.maximum(1, n - size + 1)
    bounds = np.r_[0, np.cumsum(count)[:-1]]
    at = np.repeat(first - bounds, count) + np.arange(count.sum())
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(size):
            h = _mix(h + flat[at + i] * np.uint64(2 * i + 1))
        return np.stack([np.minimum.reduceat(_mix(h ^ s), bounds) for s in seeds], axis=1)


def _signatures(bands: int, rows: int, size: int, min_chars: int):
    seeds = np.random.default_rng(5).integers(1, 2**63, bands * rows, dtype=np.uint64)
    schema = pa.schema([("id", pa.int64()), ("no", pa.int32()), ("from_pos", pa.int64()), ("to_pos", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        for batch in batches:
            places = [(i, no, a, b, text[a:b]) for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True) for no, (a, b) in enumerate(split(text)) if b - a >= min_chars]
            for c in range(0, len(places), 4096):
                part = places[c : c + 4096]
                ws = [words_of(p[4]) for p in part]
                with np.errstate(over="ignore"):
                    least = _minima(ws, size, seeds, known).reshape(len(ws), bands, rows)
                    keys = _mix(np.arange(bands, dtype=np.uint64) + _mix(least * np.arange(1, 2 * rows, 2, dtype=np.uint64)).sum(2, dtype=np.uint64)).view(np.int64)
                d = [xxhash.xxh3_128_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) for w in ws]
                cols = [*zip(*(p[:4] for p in part), strict=True), [(x >> 64) - 2**63 for x in d], [(x & (2**64 - 1)) - 2**63 for x in d]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))], schema=schema)
            if len(known) > 1_000_000:
                known.clear()
    return run


def _shingled(size: int):
    """The shingles of the paragraphs ``nos`` of each record, by 64 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, nos in zip(*(batch[c].to_pylist() for c in ("id", "text", "nos")), strict=True):
                places = split(text)
                out += [(i, no, [hash_of(x) - 2**63 for x in shingles(words_of(text[slice(*places[no])]), size)]) for no in nos]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64()))], names=["id", "no", "set"])

    return run


def paragraph_classes(docs: DataFrame, similarity: float = 0.8, bands: int = 8, rows: int = 3, size: int = 5, min_chars: int = 0, small: int = 512) -> DataFrame:
    """Of every paragraph its class: ``id``, ``no`` (from 0), ``from_pos``, ``to_pos``, ``first_id``, ``first_no`` (the class's first paragraph), ``n_links`` (to
    different texts) and ``stays`` (whether it is that first one).

    ``docs``: ``id`` (bigint, unique) and ``text``. Letter case, punctuation and white space don't count. A paragraph without words is none, nor is one of fewer than ``min_chars`` characters;
    one of fewer than five words is a shingle of its own. Null and empty texts have no paragraphs; equal texts under
    different ids are one class; texts of any length are handled; an empty input gives an empty result. Columns of other names are ignored.
    Two similar paragraphs that meet in any bucket are linked, however large it is. Buckets of more than ``small`` different texts are cut into parts, each compared with itself and each other one; results don't depend on ``small``.
    """
    docs = docs.select("id", "text").where("text is not null")
    sig = kept(docs.mapInArrow(_signatures(bands, rows, size, min_chars), "id bigint, no int, from_pos bigint, to_pos bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    p = F.struct("id", "no")
    texts = kept(sig.groupBy("d1", "d2").agg(F.min(p).alias("p"), F.min_by("keys", p).alias("keys")))  # different ones, by 128 bits
    members = texts.select(F.posexplode("keys").alias("band", "key"), "p")
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bucket = kept(members.join(several.select("key"), "key", "left_semi").select("key", "p"))
    # similar paragraphs share most of their buckets: of those with the same members, told by 128 bits, one is enough
    own = bucket.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "p")).alias("y"))
    one = cut(own.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / small).cast("int").alias("cuts")))
    bucket = bucket.join(one, "key")
    need = bucket.select("p.*").distinct().groupBy("id").agg(F.collect_list("no").alias("nos"))  # of one record each
    sets = kept(docs.join(need, "id").mapInArrow(_shingled(size), "id bigint, no int, set array<bigint>").select(p.alias("p"), "set"))
    met = bucket.join(sets, "p")
    met = met.withColumn("cut", F.pmod(F.xxhash64("p", "key"), F.col("cuts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("key", F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j"), "cut", "p", "set")
    other = met.select("key", "i", "j", F.col("cut").alias("cut_b"), F.col("p").alias("b"), F.col("set").alias("set_b"))
    n, m = F.size("set"), F.size("set_b")
    likely = F.least(n, m) / F.greatest(n, m) >= similarity  # what both have is at most the smaller set, what any has at least the larger
    likeness = F.get(F.transform(F.array(F.size(F.array_intersect("set", "set_b"))), lambda x: x / (n + m - x)), 0)
    pairs = met.join(other, ["key", "i", "j"]).where((F.col("p") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("cut") != F.col("cut_b"))))
    links = cut(pairs.where(F.when(likely, likeness >= similarity).otherwise(False)).select(F.col("p").alias("a"), "b").distinct())
    whole = sig.join(texts.select("d1", "d2", "p"), ["d1", "d2"])
    n = links.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count("*").alias("n_links"))
    label = components(links).withColumnRenamed("node", "p")
    whole = whole.join(label, "p", "left").join(n, "p", "left").withColumn("first", F.coalesce("component", "p")).fillna(0, ["n_links"])
    stays = (F.col("first.id") == F.col("id")) & (F.col("first.no") == F.col("no"))
    return whole.select("id", "no", "from_pos", "to_pos", F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no"), "n_links", stays.alias("stays"))
