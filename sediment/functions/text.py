"""Text functions as column expressions: tokens, names, quotes, simple facts, sentences, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists. Letters, digits and underscore, their bounds and white space are spelled out, as \w, \b and \s are ASCII in some engines.
WORD = r"[\p{L}\p{N}_]+"
BEFORE, AFTER, BLANK = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
NAME = rf"{BEFORE}([A-Z][a-z]+(?:{BLANK}[A-Z][a-z]+)*){AFTER}"
QUOTED = r'"([^"]+)"'
FACT = rf"(?i){BEFORE}({WORD}(?:{BLANK}{WORD})?){BLANK}(uses?|is|was|has|prefers?|decided|switched to|moved to){BLANK}({WORD}(?:{BLANK}{WORD})?){AFTER}"
FACT_VERB = rf"(?i){BLANK[:-1]}(?:uses?|is|was|has|prefers?|decided|switched to|moved to){BLANK[:-1]}"
# Cues of what is worth keeping, case aside, between bounds of words; and of secrets.
USER_GLOBAL_CUES = r"always|never|from now on|i prefer|my preference|my workflow|remember that i|remember my"
USER_PROJECT_CUES = (
    r"remember|we (?:use|decided|switched|moved|chose|prefer)|the (?:project|repo|repository|app|service) (?:uses|is|has|needs)|"
    r"our (?:stack|database|architecture|convention|status|goal)|current (?:status|goal|decision)"
)
ASSISTANT_OUTCOME_CUES = r"implemented|fixed|resolved|updated|added|removed|migrated|refactored|benchmark(?:ed|s)?|tests? (?:pass|passed|passing)|committed|deployed|root cause|verification|completed"
SECRET_CUES = r"(?i)(?:-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bsk-[A-Za-z0-9_-]{16,}\b|\b(?:password|passwd|api[_-]?key|access[_-]?token)\s*[:=]\s*\S+)"
#: What a candidate is: its scope, kind, how it is known, and its confidence.
CANDIDATES = {
    "global": ("global", "user_preference", "user_stated", 0.95),
    "project": ("project", "project_fact", "user_stated", 0.9),
    "outcome": ("project", "work_outcome", "assistant_reported", 0.65),
}


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def white_tokens(c: Column) -> Column:
    """Split at single blanks, case kept, empty tokens kept."""
    return F.split(c, " ", -1)


def token_estimate(c: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0))), F.lit(0))


def proper_names(c: Column) -> Column:
    """Runs of capitalised words, longer than two letters, first occurrences in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(NAME), F.lit(1)), lambda x: F.length(x) > 2))


def quoted(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))


def facts(c: Column) -> Column:
    """Structs subject, predicate, object of a simple verb pattern. Only texts that have one of the verbs between blanks, as every fact has, are searched for it."""
    whole = F.regexp_extract_all(F.when(F.regexp_like(c, F.lit(FACT_VERB)), c).when(c.isNotNull(), F.lit("")), F.lit(FACT), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, FACT, i)
    return F.transform(whole, lambda x: F.struct(part(x, 1).alias("subject"), F.replace(F.lower(part(x, 2)), F.lit(" "), F.lit("_")).alias("predicate"), part(x, 3).alias("object")))


def sentences(c: Column) -> Column:
    """Sentences, split after . ! ? and white space; blank ones left out."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def window_starts(n: Column, size: int = 4, stride: int = 2) -> Column:
    """Starts of windows of ``size`` over ``n`` places at every ``stride``; the last window always ends at the end, none comes twice; no places, no window."""
    last = F.greatest(F.lit(0), n - size)
    every = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(stride)), last))
    return F.when(n > 0, every).otherwise(F.array().cast("array<int>"))


def windows_of(i: Column, n: Column, size: int = 4, stride: int = 2) -> Column:
    """Starts of the windows (see window_starts) that hold place ``i`` of ``n``: those at the stride that reach it, of which there are at most size / stride, and the last."""
    i, n = i.cast("int"), n.cast("int")
    last = F.greatest(F.lit(0), n - size)
    low = F.greatest(F.lit(0), F.floor((i - size + stride) / stride) * stride).cast("int")
    high = F.least(F.floor(i / stride) * stride, F.floor(last / stride) * stride).cast("int")
    every = F.when(low <= high, F.sequence(low, high, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.when(i >= last, F.array_distinct(F.array_append(every, last))).otherwise(every)


def windows(items: Column, size: int = 4, stride: int = 2, glue: str = " ") -> Column:
    """Structs ``start`` and ``text`` of overlapping windows over an array of strings."""
    return F.transform(window_starts(F.size(items), size, stride), lambda s: F.struct(s.alias("start"), F.array_join(F.slice(items, s + 1, F.lit(size)), glue).alias("text")))


def render_fact(subject: Column, predicate: Column, value: Column, name: Column, raw: Column) -> Column:
    """Subject, predicate with blanks, and value, else the object's name, else its id; an empty value falls through."""
    said = F.coalesce(F.when(value != "", value), name, raw, F.lit(""))
    return F.trim(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.replace(predicate, F.lit("_"), F.lit(" ")), said))


def durable_candidate(role: Column, content: Column) -> Column:
    """What a message is worth keeping as: ``scope``, ``kind``, ``verification``, ``confidence``. A user's lasting preference before a fact on the project; an
    assistant's outcome if its excerpt isn't empty; null if it is nothing of these or holds a secret."""
    user, assistant = F.lower(F.trim(role)).isin("user", "human"), F.lower(F.trim(role)).isin("assistant", "bot", "ai")
    cue = lambda words: content.rlike(f"(?i){BEFORE}(?:{words}){AFTER}")
    what = lambda k: F.struct(*(F.lit(v).alias(n) for n, v in zip(("scope", "kind", "verification", "confidence"), CANDIDATES[k], strict=True)))
    return (
        F.when(content.rlike(SECRET_CUES), None)
        .when(user & cue(USER_GLOBAL_CUES), what("global"))
        .when(user & cue(USER_PROJECT_CUES), what("project"))
        .when(assistant & cue(ASSISTANT_OUTCOME_CUES) & (durable_excerpt(content) != ""), what("outcome"))
    )


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}|{BLANK}$", "")


def durable_excerpt(c: Column, most: int = 2400) -> Column:
    """Text without fenced code, blank lines, bare links and heading marks, cut to ``most`` characters."""
    bare = F.regexp_replace(c, r"(?s)```.*?```", "")
    lines = F.transform(F.split(bare, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), stripped)
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("http://") & ~x.startswith("https://"))
    return stripped(F.substring(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, rf"^#{{1,6}}{BLANK}", "")), "\n"), 1, most))
