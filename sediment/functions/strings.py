"""Edit distance of at most one, as a Python function and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within_one_edit(a: str, b: str) -> bool:
    """Equal, or one letter replaced, inserted or left out, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def deletions(c: Column) -> Column:
    """The string and all that arise by leaving out one letter: strings within one edit of each other share at least one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.when(F.length(c) > 0, F.array_distinct(F.concat(F.array(c), cut))).otherwise(F.array(c))


def near(a: Column, b: Column) -> Column:
    """Within one edit, a swap of letters close by included, for strings that share one of their deletions."""
    moved = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.levenshtein(a, b, 1).between(0, 1) | moved
