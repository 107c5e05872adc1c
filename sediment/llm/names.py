"""Variant spellings of the names of persons and organisations, linked by merging and matching again.

A name is taken apart: titles and legal forms go; a person has a family name and a given name, an initial or a familiar form;
an organisation a proper name and a line of business. Equal parts make a profile. Profiles block on their name with one
letter left out and on the letter's place, or on the letter itself where it moved, so all of a block are one edit apart; each
block is linked to its strongest member. Merged profiles pool their spellings, initials and given names. The richer profiles
go back into blocking: initials and familiar forms look for the one member of the family that fits, and a spelling that got
its given name from its group looks for misspelt names again, until a round brings no merge.
"""

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.strings import deletions, near, within_one_edit
from sediment.operators.components import components
from sediment.session import cut

# Vocabulary of names.
TITLES = frozenset("mr mrs ms miss mx dr prof professor herr frau hr fr mme mlle madame monsieur sir dame jr sr phd".split())
LEGAL = frozenset("gmbh mbh ag aktiengesellschaft ltd limited llc plc inc incorporated sa sas sarl bv nv kg ohg se corp corporation co company spa oy ab as".split())
PERSON = frozenset("person human individual".split())
ORGANISATION = frozenset("organisation organization org company firm business".split())
KINDS = ("person", "org")


def fold(name: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c)).replace("ł", "l").replace("ø", "o")


def words(name: str) -> tuple[list[str], int, bool]:
    """Folded words without dots inside abbreviations; how many stand before a comma (0: no comma); whether a word ends in a dot."""
    text = fold(name).strip()
    before = len(re.findall(r"[^\W_]+", re.sub(r"[.'’]", "", text.split(",")[0]))) if "," in text else 0
    return re.findall(r"[^\W_]+", re.sub(r"[.'’]", "", text)), before, bool(re.search(r"\w{3,}\.(\s|$)", text))


def last_words(names: DataFrame, min_names: int = 3) -> DataFrame:
    """Candidates for lines of business: words before a legal form, with at least ``min_names`` different words before them."""
    legal = "|".join(sorted(LEGAL))
    low = F.translate(F.lower(F.trim("name")), ".,", "")
    m = rf"^(?:the )?(.+?)[ -]([^\s-]+) (?:{legal})$"
    return (
        names.select(F.regexp_extract(low, m, 1).alias("stem"), F.regexp_extract(low, m, 2).alias("word"))
        .where("word <> '' and stem <> ''")
        .groupBy("word")
        .agg(F.count_distinct("stem").alias("n"))
        .where(F.col("n") >= min_names)
        .select("word", "n")
    )


class _Near:
    """Words by all they can be misread as: those within one edit of a word share it, or one of the strings that arise by leaving out a letter."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.by: dict[str, list[str]] = {}
        for w in words:
            self.add(w)

    @staticmethod
    def _keys(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def add(self, w: str) -> None:
        for k in self._keys(w):
            self.by.setdefault(k, []).append(w)

    def of(self, w: str) -> set[str]:
        return {x for k in self._keys(w) for x in self.by.get(k, ()) if within_one_edit(w, x)}


class Parser:
    """Takes names apart. ``given``: pairs of given name and familiar form; ``lines``: words for lines of business, most frequent first."""

    def __init__(self, given: list[tuple[str, str]], lines: list[str]) -> None:
        self.full = {fold(a).strip() for a, _ in given if a}
        self.near_full = _Near(sorted(self.full))
        self.short: dict[str, set[str]] = {}
        for a, b in given:
            if a and b:
                self.short.setdefault(fold(b).strip(), set()).add(fold(a).strip())
        self.lines: set[str] = set()
        self.near_lines, self.beginning = _Near(), {}
        for w in map(fold, lines):  # a misspelt line is near a more frequent one, an abbreviated one its beginning
            if w not in self.beginning and not self.near_lines.of(w):
                self.lines.add(w)
                self.near_lines.add(w)
                for i in range(1, len(w) + 1):
                    self.beginning.setdefault(w[:i], set()).add(w)
        self.known: dict[str, str | None] = {}
        self.line_known: dict[str, str | None] = {}

    def given_of(self, w: str) -> str | None:
        """The given name that a word is, or is one edit away from."""
        if w not in self.known:
            hit = w if w in self.full else None
            if hit is None and len(w) >= 5 and w not in self.short:
                close = self.near_full.of(w)
                hit = min(close) if len(close) == 1 else None
            self.known[w] = hit
        return self.known[w]

    def line_of(self, w: str, dotted: bool) -> str | None:
        """The line of business that a word is, is one edit away from, or abbreviates."""
        key = f"{w}.{dotted}"
        if key not in self.line_known:
            hit = w if w in self.lines else None
            if hit is None and len(w) >= 4:
                close = self.near_lines.of(w)
                hit = min(close) if len(close) == 1 else None
            if hit is None and dotted and len(w) >= 3:
                close = self.beginning.get(w, set())
                hit = min(close) if len(close) == 1 else None
            self.line_known[key] = hit
        return self.line_known[key]

    def parse(self, name: str | None, kind: str | None) -> tuple[str, str, str, str] | None:
        """Kind, core, part and hint; None where the name is neither a person's nor an organisation's."""
        if not name:
            return None
        kind = fold(kind).strip() if kind else ""
        if kind and kind not in PERSON and kind not in ORGANISATION:
            return None
        ws, before, dotted = words(name)
        if not ws or any(c.isdigit() for w in ws for c in w):
            return None
        bare = [w for w in ws if w not in LEGAL and w != "the"]
        legal = len(bare) < len([w for w in ws if w != "the"])
        lines = [(i, k) for i, w in enumerate(bare) if (k := self.line_of(w, dotted))]
        is_given = [self.given_of(w) for w in bare]
        exact_line = any(w in self.lines for w in bare)
        org = legal or kind in ORGANISATION or exact_line or (bool(lines) and not any(is_given) and kind not in PERSON)
        if org and len(bare) > 0:
            at, line = (lines[-1] if lines else (-1, ""))
            stem = [w for i, w in enumerate(bare) if i != at]
            return ("org", " ".join(stem), line, "") if stem else ("org", " ".join(bare), "", "")
        bare = [w for w in ws if w not in TITLES]
        if len(bare) < 2 or len(bare) > 4:
            return ("person", " ".join(bare), "", "") if kind in PERSON and bare else None
        if before:
            n = sum(w not in TITLES for w in ws[:before])
            bare = bare[n:] + bare[:n]
        elif not self.given_of(bare[0]) and bare[0] not in self.short and len(bare[0]) > 1 and (self.given_of(bare[-1]) or (kind in PERSON and bare[-1] in self.short) or len(bare[-1]) == 1):
            bare = [bare[-1], *bare[1:-1], bare[0]]  # family name first, without a comma
        first, family = bare[0], [w for w in bare[1:] if len(w) > 1]
        if not family:
            return ("person", " ".join(bare), "", "") if kind in PERSON else None
        core = "".join(family)
        if full := self.given_of(first):
            return "person", core, full, ""
        if len(first) == 1:
            return "person", core, "", f"i:{first}"
        if first in self.short:
            fulls = sorted(self.short[first])
            return ("person", core, fulls[0], "") if len(fulls) == 1 else ("person", core, "", "l:" + "|".join(fulls))
        if kind in PERSON or not kind:
            return "person", core, "", f"n:{first}"
        return None


def _fits(part, hint):
    """How well a given name fits a hint: 0 best, null not at all."""
    what, text = F.substring(hint, 1, 2), F.expr("substring(hint, 3)")
    # a familiar form without its ending: double letters single, final vowels and y gone
    stem = F.regexp_replace(F.regexp_replace(text, r"(?:ie|[aeiouy])$", ""), r"(.)\1$", "$1")
    return (
        F.when((what == "i:") & (F.substring(part, 1, 1) == text), 0)
        .when((what == "l:") & F.array_contains(F.split(text, r"\|"), part), 0)
        .when((what == "n:") & part.startswith(text), 0)
        .when((what == "n:") & (F.length(stem) >= 2) & part.startswith(stem), 1)
        .when((what == "n:") & (F.length(text) >= 3) & part.endswith(text), 2)
        .when((what == "n:") & (F.length(stem) >= 3) & part.contains(stem), 3)
    )


def _one_off(core):
    """Keys that strings one edit apart share: the string without a letter, and that letter's place or the letter; the string itself for every place of a letter too many."""
    n, none = F.length(core), F.lit(None)
    cut_at = lambda i: F.concat(F.substr(core, F.lit(1), i - 1), F.substr(core, i + 1))
    key = lambda text, place, letter: F.struct(text.alias("text"), place.cast("int").alias("place"), letter.cast("string").alias("letter"))
    places = F.sequence(F.lit(1), n)
    replaced = F.transform(places, lambda i: key(cut_at(i), i, none))
    moved = F.array_distinct(F.transform(places, lambda i: key(cut_at(i), none, F.substr(core, i, F.lit(1)))))
    added = F.transform(F.sequence(F.lit(1), n + 1), lambda i: key(core, i, none))
    return F.when(n > 0, F.concat(replaced, moved, added))


def _misspelt(blocked: DataFrame, rare: int, share: float) -> DataFrame:
    """Links ``a``, ``b`` from profiles to the strongest member of each of their blocks. ``blocked``: ``_k``, ``pid``, ``core``, ``n_ids``, ``spellings``, ``n``."""
    heads = blocked.groupBy("_k").agg(F.max(F.struct("n_ids", "n", "core", "pid", "spellings")).alias("h"), F.count("*").alias("c")).where("c > 1").select("_k", "h")
    unsure = (F.least("spellings", "h.spellings") <= rare) | (F.least("n_ids", "h.n_ids") <= share * F.greatest("n_ids", "h.n_ids"))
    found = blocked.join(heads, "_k").where((F.col("pid") != F.col("h.pid")) & unsure & near(F.col("core"), F.col("h.core")))
    return found.select(F.col("pid").alias("a"), F.col("h.pid").alias("b")).distinct()


def link_names(entities: DataFrame, given_names: DataFrame, rare: int = 2, share: float = 0.02) -> DataFrame:
    """Groups of entities that mean the same person or organisation: ``id`` and ``grp``, for every id with a usable name.

    ``entities``: ``id``, ``name``, ``entity_type``; ``given_names``: ``full_name``, ``short_name`` (at most 100,000 rows). Two names one
    edit apart, of one given name or line of business, are linked if one of the two family or proper names is written in at most
    ``rare`` ways in all its entities, or has at most ``share`` of the other's ids, so that established names stay apart.
    Neither depends on how often the same names are stored. An initial or a familiar form is linked only if exactly one
    member of the family fits it best.

    Left out are ids without a name, of other types, or whose names hold digits. An id stored twice counts once. Ties of
    strength go to the greater name. Empty inputs give an empty result. Columns of other names are ignored.
    """
    src = entities.select("id", "name", "entity_type").where("id is not null and name is not null")
    pairs = [(r[0], r[1]) for r in given_names.select("full_name", "short_name").limit(100_001).collect()]
    lines = [r.word for r in last_words(src.where(F.lower(F.trim("entity_type")).isin(*ORGANISATION) | F.col("entity_type").isNull()).select("name")).orderBy(F.desc("n"), "word").limit(20_001).collect()]
    if len(pairs) > 100_000 or len(lines) > 20_000:
        raise ValueError("more than 100,000 given names or 20,000 lines of business")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(pairs, lines)
        for batch in batches:
            rows = [(i, *p, " ".join(words(n)[0])) for i, n, t in zip(*(batch[c].to_pylist() for c in ("id", "name", "entity_type")), strict=True) if (p := parser.parse(n, t))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["id", "kind", "core", "part", "hint", "spelling"])

    parsed = src.mapInArrow(run, "id string, kind string, core string, part string, hint string, spelling string").dropDuplicates(["id"])
    parsed = cut(parsed.withColumn("pid", F.xxhash64("kind", "core", "part", "hint")))
    ways = parsed.groupBy("kind", "core", "spelling").agg(F.count("*").alias("n")).groupBy("kind", "core").agg(F.sum("n").alias("n_ids"), F.count("*").alias("spellings"))
    profiles = cut(parsed.groupBy("pid", "kind", "core", "part", "hint").agg(F.count("*").alias("n")).join(ways, ["kind", "core"]))

    def block(rows: DataFrame) -> DataFrame:
        # equal given name or line, and equal core but for a letter at one place (or the core without it), or a letter that moved
        key = F.xxhash64("kind", "part", "hint", "_d.text", "_d.place", "_d.letter")
        return rows.withColumn("_d", F.explode(_one_off(F.col("core")))).select(key.alias("_k"), "pid", "core", "n_ids", "spellings", "n")

    blocked = block(profiles)
    edges = cut(_misspelt(blocked, rare, share))
    hints = profiles.where("kind = 'person' and hint <> '' and length(core) >= 3").select("pid", "core", "hint")
    label, asked = cut(components(edges)), None
    while True:  # a round's links give free groups a given name, so free ones grow fewer
        merged = profiles.join(label, profiles.pid == label.node, "left").withColumn("grp", F.coalesce("component", "pid"))
        # a merged profile has the spellings of all its members, and their given name
        named = merged.where("part <> ''").groupBy("grp").agg(F.max("part").alias("part"))
        rich = merged.where("kind = 'person'").select("grp", F.col("core").alias("r_core")).distinct().join(named, "grp")
        free = hints.join(merged.select("pid", "grp"), "pid").join(named.select("grp"), "grp", "left_anti")
        f_keys = free.withColumn("_d", F.explode(deletions(F.col("core"))))
        r_keys = rich.withColumn("_d", F.explode(deletions(F.col("r_core"))))
        fit = _fits(F.col("part"), F.col("hint"))
        found = (
            f_keys.join(r_keys.withColumnRenamed("grp", "r_grp"), "_d")
            .withColumn("_fit", fit)
            .where(F.col("_fit").isNotNull() & near(F.col("core"), F.col("r_core")))
            .withColumn("_rank", F.when(F.col("core") == F.col("r_core"), 0).otherwise(10) + F.col("_fit"))
            .groupBy("pid", "grp", "r_grp")
            .agg(F.min("_rank").alias("_rank"))
        )
        best = found.groupBy("pid").agg(F.min("_rank").alias("_rank"))
        links = found.join(best, ["pid", "_rank"]).groupBy("pid").agg(F.min("r_grp").alias("a"), F.max("r_grp").alias("b")).where("a = b")
        links = links.select(F.col("pid").alias("a"), "b")
        # profiles that got a given name from their group, since the last round: back into the blocks of that name
        given = merged.where("kind = 'person' and part = ''").drop("part", "hint", "grp", "node", "component").join(merged.select("pid", "grp"), "pid").join(named, "grp").drop("grp").withColumn("hint", F.lit(""))
        fresh = cut(given if asked is None else given.join(asked, ["pid", "part"], "left_anti"))
        if fresh.take(1):
            asking = block(fresh)
            met = blocked.join(asking.select("_k").distinct(), "_k", "left_semi").unionByName(asking)
            links = links.unionByName(_misspelt(met, rare, share))
            asked = fresh.select("pid", "part") if asked is None else cut(asked.unionByName(fresh.select("pid", "part")))
        # what is one group already is no news
        grp = merged.select(F.col("pid").alias("_p"), "grp")
        ends = links.join(grp.select(F.col("_p").alias("a"), F.col("grp").alias("_a")), "a", "left").join(grp.select(F.col("_p").alias("b"), F.col("grp").alias("_b")), "b", "left")
        links = cut(ends.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
        if not links.take(1):
            break
        edges = cut(edges.unionByName(links))
        label = cut(components(edges))
    return parsed.join(label, parsed.pid == label.node, "left").select("id", F.coalesce("component", "pid").alias("grp"))


def linked_pairs(groups: DataFrame, part_rows: int = 2000) -> DataFrame:
    """All pairs of ids of a group, smaller id first: ``id_a``, ``id_b``. The ids of a large group meet in parts of about ``part_rows``, so that no task has all of its pairs."""
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"), F.count("*").alias("_n")).where("_n > 1").select("grp", "_parts")
    g = groups.join(sizes, "grp")
    one = g.select("grp", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"))
    other = g.select("grp", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts").cast("bigint") - 1)).alias("_part"))
    return one.join(other, ["grp", "_part"]).where("id_a < id_b").select("id_a", "id_b")
