"""Long exact spans that occur in more than one record.

The unit is every window of ``length`` characters. A window's signature is one MinHash row over its shingles of ``shingle``
characters: the smallest shingle hash and its place. Equal windows have a Jaccard similarity of 1, so a single band of a
single row lets every one of them collide: recall is 1, where bands over whole paragraphs would miss spans that are part of
a paragraph or cross its bounds. Neighbouring windows mostly share their smallest shingle; such a run is one row. Runs that
collide are compared exactly, first as a whole, then window by window where wholes differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.intervals import merge_periods
from sediment.session import cut, kept

#: The hash's bases and mixing factor, and the characters handled at once.
BASE, OTHER, MIX, CHUNK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of all substrings of a length in one text buffer, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.powers = base, np.ones(1, np.uint64)
        self.inverse = self.powers

    def load(self, chars: np.ndarray) -> None:
        n = len(chars)
        with np.errstate(over="ignore"):
            if len(self.powers) < n + 1:
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)], dtype=np.uint64)
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
            self.sums = np.r_[np.uint64(0), np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        with np.errstate(over="ignore"):
            return _mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inverse[: n - k + 1] + np.uint64(k))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    b = np.r_[a, np.full(-len(a) % w, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(a) - w + 1], ahead[w - 1 : len(a)])


def _pieces(ids: list, texts: list[str], overlap: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """Groups of texts of about CHUNK characters; longer texts in pieces that overlap. Yields ids, offsets in their text, pieces."""
    group: tuple[list, list[int], list[str]] = ([], [], [])
    total = 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(t) - overlap), CHUNK):
            part = t if len(t) <= CHUNK else t[at : at + CHUNK + overlap]
            group[0].append(i), group[1].append(at), group[2].append(part)
            total += len(part)
            if total >= CHUNK:
                yield group
                group, total = ([], [], []), 0
    if group[0]:
        yield group


def _chars(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(length: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Rolling()
        for batch in batches:
            for ids, base, parts in _pieces(batch["id"].to_pylist(), batch["text"].to_pylist(), length - 1):
                roll.load(_chars(parts))
                if len(roll.sums) - 1 < length:
                    continue
                least = _sliding_min(roll.all(shingle), length - shingle + 1)
                offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
                start = np.arange(len(least))
                doc = np.searchsorted(offsets, start, side="right") - 1
                inside = start + length <= offsets[doc + 1]
                start, doc, least = start[inside], doc[inside], least[inside]
                if not len(start):
                    continue
                first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
                parts = -(-np.diff(np.r_[first, len(start)]) // length)  # in repeating text a run has no bound: a new one every ``length`` windows, as ``at`` holds no more
                first = np.repeat(first, parts) + length * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                count = np.diff(np.r_[first, len(start)])
                s, d = start[first], doc[first]
                _, once = np.unique(np.stack([d.astype(np.uint64), least[first]]), axis=1, return_index=True)
                fresh = np.zeros(len(s), np.int8)
                fresh[once] = 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(ids, np.int64)[d]),
                        pa.array(least[first].view(np.int64)),
                        pa.array(roll.at(s, s + count - 1 + length).view(np.int64).astype(np.int32)),  # told apart together with h
                        pa.array((s - offsets[d] + np.asarray(base)[d]) * length + count - 1),
                        pa.array(fresh),
                    ],
                    names=["id", "h", "whole", "at", "fresh"],
                )

    return run


def _windows(length: int):
    """Windows one by one, under 128 bits: two polynomials of different bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, other = _Rolling(), _Rolling(OTHER)
        for batch in batches:
            for i, text, runs in zip(*(batch[c].to_pylist() for c in ("id", "text", "at")), strict=True):
                for p, k in ((at // length, at % length + 1) for at in runs):
                    chars = _chars([text[p : p + k - 1 + length]])
                    roll.load(chars)
                    other.load(chars)
                    h, g = roll.all(length), other.all(length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, i, np.int64)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(np.arange(p, p + k, dtype=np.int64))], names=["id", "w", "v", "pos"]
                    )

    return run


def _batched(make):
    """Small batches into batches of some 50,000 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in make(batches):
            held.append(b)
            if sum(map(len, held)) >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _in_several(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b").select(*key)


def shared_spans(docs: DataFrame, length: int = 200, shingle: int = 100, only_found: bool = False) -> DataFrame:
    """Spans of at least ``length`` characters that occur exactly so in another record.

    ``docs``: ``id`` (bigint, unique) and ``text``. Returns ``id``, ``from_pos`` and ``to_pos`` of pieces that are shared,
    0-based, in code points; pieces of one record may overlap or touch (see coverage). With ``only_found`` windows are
    compared one by one only for records without any shared run: each record with a span then has a piece, but not all.

    A null text, or one shorter than ``length``, has none. A span that recurs only within its own record doesn't count.
    Repeated texts under different ids share all of their text. A text of any length is handled, in overlapping pieces. An
    empty input gives an empty result. Columns of other names are ignored.
    """
    docs = docs.select("id", "text").where(F.length("text") >= length)
    runs = docs.mapInArrow(_batched(_runs(length, shingle)), "id bigint, h bigint, whole int, at bigint, fresh tinyint")
    # a record counts once for each shingle, so a sum beyond 1 means several records
    several = runs.groupBy("h").agg(F.sum("fresh").alias("_n")).where("_n > 1").select("h")
    collide = kept(runs.drop("fresh").join(several, "h", "left_semi"), "runs")
    pos, last = F.floor(F.col("at") / length), F.pmod(F.col("at"), F.lit(length))  # of the run's first and last window
    same = collide.join(_in_several(collide, "h", "whole"), ["h", "whole"], "left_semi")
    sure = same.select("id", pos.alias("from_pos"), (pos + last + length).alias("to_pos"))
    if only_found:
        rest = collide.join(sure.select("id").distinct(), "id", "left_anti")
    else:
        rest = collide.join(same.select("id", "at"), ["id", "at"], "left_anti")
    # of runs that are equal as a whole two stand for all, from the records of smallest and largest id: as partners that is enough
    wanted = rest.select("h").distinct()
    partners = (collide if only_found else same).join(wanted, "h", "left_semi").groupBy("h", "whole").agg(F.min(F.struct("id", "at")).alias("a"), F.max(F.struct("id", "at")).alias("b"))
    look = partners.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).select("r.*")
    if not only_found:
        look = look.unionByName(rest.select("id", "at")).distinct()
    per_doc = cut(look.groupBy("id").agg(F.collect_list("at").alias("at")))
    few = (per_doc.agg(F.sum(F.size("at"))).first()[0] or 0) <= 200_000  # runs, of eight bytes
    windows = docs.join(F.broadcast(per_doc) if few else per_doc, "id").mapInArrow(_batched(_windows(length)), "id bigint, w bigint, v bigint, pos bigint")
    windows = kept(windows, "windows")
    hits = windows.join(_in_several(windows, "w", "v"), ["w", "v"], "left_semi").select("id", F.col("pos").alias("from_pos"), (F.col("pos") + length).alias("to_pos"))
    return sure.unionByName(hits)


def coverage(spans: DataFrame) -> DataFrame:
    """Pieces of shared_spans merged into maximal spans: ``id``, ``from_pos``, ``to_pos``."""
    pieces = spans.select("id", F.col("from_pos").alias("s"), F.col("to_pos").alias("e"), F.lit(False).alias("shared"))
    return merge_periods(pieces, ["id"]).select("id", F.col("s").alias("from_pos"), F.col("e").alias("to_pos"))
