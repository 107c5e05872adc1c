"""Conversations rebuilt from message rows.

A session has two clocks: the user's, and that of the service, which stamps the messages of assistant and system. Where turn
numbers say which message came before which, each step from one clock to the other bounds their offset: a reply can't be
older than what it answers. Clocks that meet all bounds stay as they are; else the offset is the least-squares fit to all
bounds, subject to each of them. A session whose bounds leave no offset is infeasible. Times are corrected, and two sorted
lists are merged: the numbered messages, by turn, and those without a number, by corrected time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.session import cut, hot_keys, small_side

#: Roles and their spellings, the order of speakers at one time, and the time above which values are milliseconds.
ROLES = {"user": ("user", "human"), "assistant": ("assistant", "bot", "ai"), "system": ("system",)}
RANK = {"system": 0, "user": 1, "unknown": 2, "assistant": 3}
MILLIS_FROM = 1e11


def role_of(c: Column) -> Column:
    key = F.lower(F.trim(c))
    out = None
    for role, names in ROLES.items():
        out = F.when(key.isin(*names), role) if out is None else out.when(key.isin(*names), role)
    return out.otherwise("unknown")


def normal_rows(messages: DataFrame) -> DataFrame:
    """Messages of sessions: ``sid``, ``id``, ``role``, ``at`` (seconds), ``turn`` (null: none), ``usable``, ``content``. Rows without a session are left out."""
    at = F.col("timestamp").cast("double")
    turn = F.get_json_object("metadata", "$.turn").try_cast("int")
    return (
        messages.select(
            F.lower(F.trim("session_id")).alias("sid"),
            F.lower(F.trim("id")).alias("id"),
            role_of(F.col("role")).alias("role"),
            F.when(at > MILLIS_FROM, at / 1000).otherwise(at).alias("at"),
            F.when(turn >= 0, turn).alias("turn"),
            F.col("content").rlike(r"[^\s\p{Z}]").alias("_text"),
            "content",
        )
        .where("sid is not null and sid <> ''")
        .withColumn("usable", F.coalesce(F.col("_text") & F.col("role").isin("user", "assistant"), F.lit(False)))
        .drop("_text")
    )


def clock_offsets(rows: DataFrame) -> DataFrame:
    """For each session with steps between its clocks: ``sid``, ``shift`` (seconds to add to the service's times) and ``feasible``.

    The fit minimises the sum of (shift - bound) squared over the bounds of all steps inside the interval that the bounds
    leave. Of several rows for a turn the earliest counts. Sessions without turn numbers say of no message that it answers
    another, so they have no bounds and keep their times; their order is that of time in any case.
    """
    turns = rows.where("turn is not null and at is not null and role <> 'unknown'").groupBy("sid", "turn").agg(F.min(F.struct("at", (F.col("role") == "user").alias("user"))).alias("m"))
    # a step needs its neighbour only: each turn is also offered to the next, and the two meet in one group
    steps = (
        turns.select("sid", F.explode(F.array(F.struct(F.col("turn").alias("at_turn"), F.lit(1).alias("side")), F.struct((F.col("turn") + 1).alias("at_turn"), F.lit(0).alias("side")))).alias("k"), "m")
        .groupBy("sid", "k.at_turn")
        .agg(F.max(F.when(F.col("k.side") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("k.side") == 1, F.col("m"))).alias("b"))
        .where("a.user <> b.user")
    )
    low = F.when(F.col("a.user"), F.col("a.at") - F.col("b.at"))  # shift >= user's time - answer's
    high = F.when(F.col("b.user"), F.col("b.at") - F.col("a.at"))  # shift <= next user's time - service's
    fit = steps.groupBy("sid").agg(F.max(low).alias("lo"), F.min(high).alias("hi"), F.avg(F.coalesce(low, high)).alias("mean"))
    lo, hi = F.coalesce("lo", F.lit(-math.inf)), F.coalesce("hi", F.lit(math.inf))
    return fit.select("sid", (lo <= hi).alias("feasible"), F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.greatest(F.least("mean", hi), lo)).alias("shift"))


def _rank(role: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), role)


class _Sharded:
    """Running values inside sessions. A session of more than ``hot_rows`` rows is cut into shards along an order, so that no window holds it whole."""

    def __init__(self, rows: DataFrame, hot_rows: int, shards: int) -> None:
        self.hot, self.shards = hot_keys(rows, ["sid"], hot_rows), shards

    def before(self, rows: DataFrame, part: list[str], by: str, order: list, what: str, name: str) -> DataFrame:
        """Adds ``name``: ``what`` (an aggregate of SQL that adds up by itself or by its sum) over the rows of ``part`` before each one; ``by`` is the first column of the order."""
        again = "sum" if what.startswith("count") else what.split("(")[0]
        if self.hot is None:
            return rows.withColumn(name, F.expr(what).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
        at = F.percentile_approx(by, F.array(*(F.lit(i / self.shards) for i in range(1, self.shards))), 10_000)
        bounds = rows.join(self.hot, "sid", "left_semi").groupBy("sid").agg(F.array_distinct(at).alias("_b"))
        rows = rows.join(small_side(bounds), "sid", "left").withColumn("_shard", F.coalesce(F.size(F.filter("_b", lambda b: b <= F.col(by))), F.lit(0))).drop("_b")
        each = rows.groupBy(*part, "_shard").agg(F.expr(what).alias("_v"))
        each = each.select(*part, "_shard", F.expr(f"{again}(_v)").over(Window.partitionBy(*part).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
        own = F.expr(what).over(Window.partitionBy(*part, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_own", own).join(each, [*part, "_shard"])
        value = F.col("_own") + F.coalesce("_earlier", F.lit(0)) if again == "sum" else F.greatest("_own", "_earlier")
        return rows.withColumn(name, value).drop("_own", "_earlier", "_shard")


def rebuild(messages: DataFrame, hot_rows: int = 500_000, shards: int = 64) -> DataFrame:
    """All sessions in order: ``sid``, ``pos``, ``role``, ``at`` (corrected), ``turn``, ``id``, ``content``, ``usable`` and ``feasible``.

    ``pos`` numbers a session's messages from 0; it is null for those that don't count: blank ones, ones of unknown role,
    and messages sent again (same role and content within five seconds of one before). At one place the speaker who can only have come first is first. Null roles are unknown, null contents blank, null times
    earliest, null or blank sessions left out; rows stored twice count once; an empty input gives an empty result. Sessions
    of more than ``hot_rows`` rows are cut into shards along their order.
    """
    rows = cut(normal_rows(messages).dropDuplicates(["sid", "id"]))
    rows = rows.join(clock_offsets(rows), "sid", "left").withColumn("feasible", F.coalesce("feasible", F.lit(True)))
    rows = rows.withColumn("at", F.when(F.col("role") != "user", F.col("at") + F.coalesce("shift", F.lit(0.0))).otherwise(F.col("at"))).drop("shift")
    sharded = _Sharded(rows, hot_rows, shards)
    rows = rows.withColumn("_said", F.sha2("content", 256))
    rows = sharded.before(rows, ["sid", "role", "_said"], "at", ["at", "id"], "max(at)", "_before")
    rows = rows.withColumn("again", F.coalesce(F.col("at") - F.col("_before") <= 5, F.lit(False))).drop("_before", "_said")
    # numbered messages are never earlier than those of smaller turns
    rows = rows.withColumn("_group", F.col("turn").isNotNull())
    rows = sharded.before(rows.withColumn("_by", F.coalesce(F.col("turn").cast("double"), "at")), ["sid", "_group"], "_by", ["_by", "at"], "max(at)", "_reach")
    rows = rows.withColumn("_at", F.when(F.col("_group"), F.greatest("at", "_reach")).otherwise(F.col("at"))).withColumn("_turn", F.coalesce("turn", F.lit(2**31 - 1))).withColumn("_rank", _rank(F.col("role")))
    rows = rows.withColumn("kept", ~F.col("again") & (F.col("usable") | ((F.col("role") == "system") & F.col("content").isNotNull())))
    rows = sharded.before(rows, ["sid"], "_at", ["_at", "_turn", "at", "_rank", "id"], "count(case when kept then 1 end)", "pos")
    return rows.select("sid", F.when(F.col("kept"), F.col("pos")).cast("bigint").alias("pos"), "role", "at", "turn", "id", "content", "usable", "feasible")


def session_defects(messages: DataFrame, hot_rows: int = 500_000, shards: int = 64) -> DataFrame:
    """``sid`` and ``defect``: ``empty``, ``no_opening``, ``no_reply``, ``lost_turn``, ``bad_role`` (see TESTDATA.md) of the sessions that rebuild puts in order; see there."""
    return _defects(rebuild(messages, hot_rows, shards))


def _defects(rebuilt: DataFrame) -> DataFrame:
    """One aggregation, combined before the shuffle, whatever a session's size."""
    said = F.col("usable") & F.col("pos").isNotNull()
    s = rebuilt.groupBy("sid").agg(
        F.min_by(F.when(said, F.col("role")), F.when(said, F.col("pos"))).alias("first"),
        F.max_by(F.when(said, F.col("role")), F.when(said, F.col("pos"))).alias("last"),
        F.max("turn").alias("top"),
        F.count_distinct("turn").alias("n_turns"),
        F.max(F.col("role") == "unknown").alias("bad"),
    )
    cases = {
        "empty": F.col("first").isNull(),
        "no_opening": F.col("first") == "assistant",
        "no_reply": F.col("last") == "user",
        "lost_turn": F.col("n_turns") < F.col("top") + 1,
        "bad_role": F.col("bad"),
    }
    named = F.array_compact(F.array(*(F.when(c, k) for k, c in cases.items())))
    return s.select("sid", F.explode(named).alias("defect"))


def conversations(messages: DataFrame, hot_rows: int = 500_000, shards: int = 64) -> DataFrame:
    """The messages of sound sessions in order: ``sid``, ``pos`` (from 0), ``role``, ``at`` (corrected), ``id``, ``content``; see rebuild.

    Dropped are sessions with a defect or with infeasible clocks, and messages that don't count.
    """
    rebuilt = cut(rebuild(messages, hot_rows, shards))
    bad = _defects(rebuilt).select("sid").union(rebuilt.where("not feasible").select("sid")).distinct()
    return rebuilt.where("pos is not null").join(bad, "sid", "left_anti").select("sid", "pos", "role", "at", "id", "content")
