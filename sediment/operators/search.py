"""Searches by expression and by name, session documents, merged scopes, paired events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.functions.text import tokens


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W]+", text.lower())


def matches(text: Column, expression: str) -> Column:
    """Whether a text meets an expression of words, "phrases", AND, OR, NOT and parentheses; words side by side are meant with AND. NOT binds before AND, AND before OR."""
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', expression)
    padded = F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(text, F.lit(""))), " "), F.lit(" "))
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def one() -> Column:
        nonlocal at
        p = peek()
        if p is None or p == ")":
            raise ValueError(f"a word is missing in {expression!r}")
        at += 1
        if p == "NOT":
            return ~one()
        if p == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"a parenthesis is open in {expression!r}")
            at += 1
            return inner
        words = _terms(p)
        return padded.contains(f" {' '.join(words)} ") if words else F.lit(True)

    def both() -> Column:
        nonlocal at
        out = one()
        while (p := peek()) not in (None, ")", "OR"):
            at += p == "AND"
            out = out & one()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = out | both()
        return out

    found = either()
    if at < len(parts):
        raise ValueError(f"a parenthesis is missing in {expression!r}")
    return found


def find_entities(entities: DataFrame, name: str, exact: bool = False, limit: int = 20) -> DataFrame:
    """Entities whose name is ``name`` or begins with it, case aside; exact ones first, then the more confident, the more used, the smaller id. The name is taken literally."""
    key, want = F.lower(F.trim("name")), name.strip().lower()
    hit = entities.where(key == want if exact else key.startswith(want))
    return hit.orderBy((key == want).desc(), F.desc("confidence"), F.desc("access_count"), "id").limit(limit)


def session_documents(messages: DataFrame) -> DataFrame:
    """``session_id``, ``user_text``, ``all_text``: contents in order, one a line. Sessions without a text of the user are left out."""
    m = messages.where("session_id is not null and trim(content) <> ''")
    line = F.struct("timestamp", "id", "content")
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["content"]), "\n")
    out = m.groupBy("session_id").agg(join(F.when(F.col("role").isin("user", "human"), line)).alias("user_text"), join(line).alias("all_text"))
    return out.where("user_text <> ''")


def merge_scopes(results: DataFrame, order: tuple[str, ...], most_chars: int = 8000) -> DataFrame:
    """``results``: ``scope``, ``qid``, ``pos``, ``text``. Scopes one after the other, each text once (case and blanks aside), while a query's texts stay within ``most_chars``."""
    rank = F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i))), F.col("scope"))
    r = results.withColumn("_r", F.coalesce(rank, F.lit(len(order)))).withColumn("_k", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy("qid", "_k").orderBy("_r", "pos"))).where("_i = 1")
    used = F.sum(F.length("text")).over(Window.partitionBy("qid").orderBy("_r", "pos", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_u", used).where(F.col("_u") <= most_chars).select(results.columns)


def pair_events(events: DataFrame, key: str, time: str, kind: str, opening: str, closing: str) -> DataFrame:
    """The n-th opening event of each key with its n-th closing one: ``key``, ``n``, ``opened``, ``closed`` (null: not yet)."""
    e = events.where(F.col(kind).isin(opening, closing)).select(key, time, kind)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy(key, kind).orderBy(time)))
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(time)))
    return e.groupBy(key, "n").agg(at(opening).alias("opened"), at(closing).alias("closed")).where("opened is not null")


def scope_id(path: Column) -> Column:
    """A readable name for a path: its last part as a slug of at most 40 characters, and 16 digits of its hash."""
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    slug = F.substring(F.trim(F.regexp_replace(F.lower(last), r"[^a-z0-9]+", "-"), F.lit("-")), 1, 40)
    return F.concat_ws("-", slug, F.substring(F.sha2(path, 256), 1, 16))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions stored as JSON (``session_id``, ``turns``: ``role``, ``content``, ``timestamp``?) as messages; a missing time is the place of the turn."""
    turn = "struct<role: string, content: string, timestamp: double>"
    raw = spark.read.schema(f"session_id string, turns array<{turn}>").option("multiLine", "true").json(path)
    t = raw.select("session_id", F.posexplode("turns").alias("i", "t"))
    return t.select(F.sha2(F.concat_ws("|", "session_id", "i"), 256).alias("id"), F.coalesce("t.timestamp", F.col("i").cast("double")).alias("timestamp"), "t.role", "t.content", "session_id", F.to_json(F.struct(F.col("i").alias("turn"))).alias("metadata"))

