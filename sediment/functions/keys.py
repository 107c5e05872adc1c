"""Normal forms of ids, predicates and object values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the end of a period that is still open, inside the engine. Results show -1.
OPEN = 9223372036854775807


def norm_id(c: Column) -> Column:
    """Ids are the same after trimming and lower-casing."""
    return F.lower(F.trim(c))


def norm_predicate(c: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


def object_key(object_id: Column, object_value: Column) -> Column:
    """What a fact says: the object's id, or the value trimmed and in lower case, told apart by a tag."""
    return F.when(object_id.isNotNull(), F.concat(F.lit("i:"), norm_id(object_id))).otherwise(
        F.concat(F.lit("v:"), F.lower(F.trim(object_value)))
    )


#: Fixed value: seconds beyond which a time isn't one.
FAR = 9e18


def finite_time(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FAR)


def valid_period(valid_from: Column, valid_until: Column) -> Column:
    """A start and, if an end is set, a later end. NaN and an infinite start count as missing, an infinite end as open."""
    return finite_time(valid_from) & (valid_until.isNull() | (~F.isnan(valid_until) & (valid_until > valid_from)))


def end_or_open(valid_until: Column) -> Column:
    return F.when(valid_until.isNull() | (valid_until >= FAR), F.lit(OPEN)).otherwise(valid_until.cast("bigint"))


def show_end(c: Column) -> Column:
    return F.when(c == OPEN, F.lit(-1).cast("bigint")).otherwise(c)
