"""Vector functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column, dim: int) -> Column:
    """``dim`` finite values, not all zero. Null: false."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~bad & (norm(a) > 0), F.lit(False))


def unit(a: Column) -> Column:
    """At length one, in double precision; a zero vector has nulls."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def hashed(tokens: Column, dim: int = 64) -> Column:
    """A stand-in for a model: counts of an array of tokens by the first four digits of their MD5, modulo ``dim``."""
    at = F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dim)))
    count = lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(a, lambda b: b == i)).cast("float"))
    return F.transform(F.array(at), count)[0]  # bound as a variable, the places are found once
