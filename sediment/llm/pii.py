"""Personal information in free text.

Patterns propose spans, validators confirm or lower them, words nearby adjust the score; of overlapping spans the best stays.
Everything is exact code points, so that spans can be replaced by typed placeholders and all else kept.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary of the patterns.
#: Words before a number that make it something else than personal.
REFERENCE = re.compile(r"(?:part no\.?|part number|order|row|ticket|invoice|commit|host|build|docket|amount|run|version|sku|serial|eur|usd|gbp|chf|[#€$£])\s*[#:]?\s*$", re.I)
#: Words before a number that say that it identifies a person.
IDENTITY = re.compile(r"(?:passport(?: no\.?)?(?: says)?|ssn|social security|identity(?: number)?|id|ausweis(?:nummer)?|national id|nino|nie|steuer-?id|record lists .{0,40}|use)\s*[:=#]?\s*$", re.I)
#: Words before a number that say that it is a telephone's.
CALL = re.compile(r"(?:tel|phone|call|whatsapp me|number is|mobile|fax|appelle le|ruf|unter|on|fon|handy)\.?\s*[:=]?\s*$", re.I)
STREET_EN = "drive|avenue|ave|lane|street|st|road|rd|court|quay|place|square|terrace|boulevard|crescent|close|way|walk|row|hill|gardens|grove|parade|mews"
STREET_FR = "rue|avenue|impasse|boulevard|chemin|allée|place|quai|cours|ruelle|sentier|passage|route"
STREET_DE = "straße|strasse|gasse|weg|allee|ring|platz|damm|ufer|steig|chaussee|promenade"
TITLES = "mr mrs ms miss mx dr prof sir herr frau hr fr mme mlle m monsieur madame".split()
#: Words that follow a name-like pair in an organisation's name.
ORGANISATION = re.compile(
    r"(?:[\s-]+(?:&|and|und|et)\s+(?:co|sons|partners|partner|söhne|fils|associates|brothers)\b)|[\s-]+(?:notaries|foundation|trust|institute|company|group|holding|holdings|associates|partners|partner|"
    r"solicitors|consulting|logistics|shipping|foods|seeds|brewing|insurance|printing|robotics|pharma|dairy|energy|textiles|timber|analytics|media|mining|optics|railways|ceramics|school|prize|award|library|"
    r"museum|hospital|college|university|stiftung|verlag|gmbh|ag|se|kg|ohg|ltd|limited|llc|llp|plc|inc|corp|sa|sas|sarl|bv|nv|s\.a\.|a\.g\.|b\.v\.|street|road|lane|avenue|drive|square|bridge|station)\b",
    re.I,
)
#: Words in a family name's place that are none.
COMMON = frozenset(
    (
        "the a an and or but if of to in on at by for from with about as is are was were be been has have had will would can could do does did not no yes i you he she it we they me him her us them my your his our "
        "their this that these those there here what which who when where why how then than so also now next please thanks thank understood noted done ok okay hello hi dear regards best kind sincerely cheers sorry "
        "ask call tell write send remind let see meet met signed contact note cc from re fwd team office project deliver use lives moved wants approved asked said says called wrote before after until since within "
        "tonight today tomorrow yesterday week month year january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
        "und oder der die das ist sind ein eine nicht mit von zu auf unter für bitte danke hallo liebe lieber kannst ich du er sie wir ihr le la les un une et ou de du des à est sont merci bonjour peux tu je il elle nous "
        "vous emergency manager owner user assistant system agent via per earlier according can frau herr mr mrs ms dr mme port saint sankt new old north south east west"
    ).split()
)

WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
AT = r"(?:\s?@\s?|\s*[\[(]\s*(?:at|ät)\s*[\])]\s*|\s+at\s+(?=[\w-]+(?:\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)))"
DOT = r"(?:\.|\s*[\[(]\s*(?:dot|punkt|point)\s*[\])]\s*|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+@-])[\w+-](?:[\w.+%'-]{{0,62}}[\w+-])?{AT}[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{0,4}}{DOT}[^\W\d_]{{2,24}}(?![\w@])", re.I)
PHONES = [
    (0.8, re.compile(r"(?<![\w+.])\+\d{1,3}(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,5}){1,6}(?![\w])")),
    (0.7, re.compile(r"(?<![\w.])00\d{1,3}[/ .-](?:\(0\)[/ .-]?)?\d{1,5}(?:[/ .-]\d{2,9}){1,4}(?!\w)")),
    (0.8, re.compile(r"(?<![\w.])\(0?\d{2,5}\)[ ./-]?\d{2,5}(?:[ ./-]\d{2,6}){0,3}(?!\w)")),
    (0.5, re.compile(r"(?<![\w.-])[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}(?![\w-]|\.\d)")),
    (0.5, re.compile(r"(?<![\w.-])0[1-9]\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,4})?(?![\w-]|[.,]\d)")),
]
IDS = [
    ("ssn", 0.5, re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|[.,]\d)")),
    ("nino", 0.8, re.compile(r"(?<!\w)[A-Z]{2}( ?)\d{2}\1\d{2}\1\d{2}\1[A-D](?!\w)", re.I)),
    ("nie", 0.6, re.compile(r"(?<!\w)[XYZ]-?\d{7}-?[A-Z](?!\w)", re.I)),
    ("dni", 0.4, re.compile(r"(?<!\w)\d{8}-?[A-HJ-NP-TV-Z](?!\w)")),
    ("birth", 0.5, re.compile(r"(?<![\w.-])\d{6}[-+]\d{4}(?![\w-]|[.,]\d)")),
    ("pass", 0.5, re.compile(r"(?<!\w)[A-Z]{1,2}\d{7,8}(?!\w)")),
    ("iban", 0.3, re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
    ("card", 0.2, re.compile(r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w)")),
]
NUMBER = r"\d{1,4}(?:\s?[a-z](?!\w))?"
ADDRESS = re.compile(
    rf"(?<![\w.,/-]){NUMBER},? (?:{STREET_FR}) (?:de la |de l'|de |du |des |d'|la |le |les )?{WORD}(?: {WORD})??(?=[\s,.;)]|$)"
    rf"|(?<![\w./-]){NUMBER} (?:{WORD} ){{1,2}}?(?:{STREET_EN})(?!\w)"
    rf"|(?<!\w)(?:[^\W\d_]+(?:{STREET_DE})|[^\W\d_]+str\.) {NUMBER}(?![\w/]|[.,]\d)"
    rf"|(?<!\w)(?:an? der |am |auf der )?[^\W\d_]+[- ](?:{STREET_DE}) {NUMBER}(?![\w/]|[.,]\d)",
    re.I,
)
NIE_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([int(x) for x in digits])):
        c = c * 2 if i % 2 else c
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def spanish(letters: str) -> bool:
    s = letters.upper().replace("-", "")
    n = s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
    return n.isdigit() and NIE_LETTERS[int(n) % 23] == s[-1]


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def _ids(text: str) -> Iterator[Span]:
    for name, base, pattern in IDS:
        for m in pattern.finditer(text):
            score, before, raw = base, text[max(0, m.start() - 60) : m.start()], m.group()
            plain = re.sub(r"[ -]", "", raw)
            if name == "iban":
                score += 0.6 if len(plain) >= 15 and mod97(plain) else -0.3
            elif name == "card":
                score += 0.5 if 13 <= len(plain) <= 19 and luhn(plain) else -0.2
            elif name in ("nie", "dni"):
                score += 0.4 if spanish(raw) else -0.1
            if REFERENCE.search(before):
                score -= 0.6
            elif IDENTITY.search(before):
                score += 0.4
            if score >= 0.5:
                yield Span(m.start(), m.end(), "ID_NUMBER", score)


def _phones(text: str) -> Iterator[Span]:
    for base, pattern in PHONES:
        for m in pattern.finditer(text):
            digits, before = sum(c.isdigit() for c in m.group()), text[max(0, m.start() - 30) : m.start()]
            score = base + (0.2 if CALL.search(before) else 0.0) - (0.6 if REFERENCE.search(before) else 0.0)
            if 8 <= digits <= 15 and score >= 0.5:
                yield Span(m.start(), m.end(), "PHONE", score)


class Finder:
    """Finds spans. ``given``: given names, ``familiar``: their familiar forms."""

    def __init__(self, given: Iterable[str], familiar: Iterable[str] = ()) -> None:
        self.given = {g.casefold() for g in given}
        self.familiar = {f.casefold() for f in familiar} - self.given
        names = sorted(self.given | self.familiar, key=lambda n: (-len(n), n))
        one = "|".join(map(re.escape, names)) or r"(?!)"
        mid = r"(?: [A-Z]\.?)?"
        self.forward = re.compile(rf"(?<![\w'’-])(?P<g>{one}){mid}[ \t]+(?P<f>{WORD})(?!\w)", re.I)
        self.reverse = re.compile(rf"(?<![\w'’-])(?P<f>{WORD})(?P<c>,?)[ \t]+(?P<g>{one}){mid}(?![\w'’-])", re.I)
        self.initial = re.compile(rf"(?<![\w'’.-])[A-Z]\.(?: ?[A-Z]\.)? ?(?P<f>{WORD})(?!\w)")
        self.trailing = re.compile(rf"(?<![\w'’.-])(?P<f>{WORD}),[ \t]+[A-Z]\.(?: ?[A-Z]\.)?(?!\w)")

    def _family(self, f: str, lower: bool) -> bool:
        key = f.casefold()
        if len(f) < 2 or key in COMMON or key in TITLES or (key in self.given and not lower):
            return False
        return f[0].islower() if lower else f[0].isupper()

    def _names(self, text: str) -> Iterator[Span]:
        for m in self.forward.finditer(text):
            g, f = m["g"], m["f"]
            lower = g[0].islower()
            if lower and (g.casefold() in self.familiar or not self._family(f, True)):
                continue
            if (lower or self._family(f, False)) and not ORGANISATION.match(text, m.end()) and not ORGANISATION.match(text, m.start("f") - 1):
                yield Span(m.start(), m.end(), "NAME", 0.9)
        for m in self.reverse.finditer(text):
            g, f = m["g"], m["f"]
            lower = f[0].islower()
            if lower and (not m["c"] or g[0].isupper() or g.casefold() in self.familiar) or not self._family(f, lower):
                continue
            if not m["c"] and (g[0].islower() or g.casefold() in self.familiar):
                continue
            yield Span(m.start(), m.end(), "NAME", 0.8 if m["c"] else 0.6)
        for m in self.initial.finditer(text):
            if self._family(m["f"], False) and m["f"].casefold() not in self.familiar and not ORGANISATION.match(text, m.end()):
                yield Span(m.start(), m.end(), "NAME", 0.7)
        for m in self.trailing.finditer(text):
            rest = text[m.end() : m.end() + 3].lstrip(" ")
            if self._family(m["f"], False) and not (text[m.end() : m.end() + 1] == " " and rest[:1].isupper()):
                yield Span(m.start(), m.end(), "NAME", 0.65)

    def find(self, text: str | None) -> list[Span]:
        """Spans in order, none overlapping another. A null or empty text has none."""
        if not text:
            return []
        found = [Span(m.start(), m.end(), "EMAIL", 2.0) for m in EMAIL.finditer(text)] if "@" in text or "at" in text.lower() or "ät" in text else []
        if any(c.isdigit() for c in text):
            found += _ids(text)
            found += _phones(text)
            found += (Span(m.start(), m.end(), "ADDRESS", 0.9) for m in ADDRESS.finditer(text) if not REFERENCE.search(text[max(0, m.start() - 20) : m.start()]))
        found += self._names(text)
        taken: list[Span] = []
        for s in sorted(found, key=lambda s: (-s.score, s.start, -s.end)):
            if all(s.end <= t.start or s.start >= t.end for t in taken):
                taken.append(s)
        return sorted(taken, key=lambda s: s.start)

    def mask(self, text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
        return "".join([*out, text[at:]])


def _lexicon(names: DataFrame) -> tuple[list[str], list[str]]:
    rows = names.select("full_name", "short_name").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 given names")
    return sorted({r[0].strip() for r in rows if r[0] and r[0].strip()}), sorted({r[1].strip() for r in rows if r[1] and r[1].strip()})


def find_pii(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts``: ``tbl``, ``rec_id``, ``text``; ``names``: ``full_name``, ``short_name`` (given names, at most 100,000 rows). One row per
    occurrence: ``tbl``, ``rec_id``, ``pii_type``, ``start_pos``, ``end_pos`` (exclusive, code points).

    Whole texts of any length. Null and empty texts have no rows, repeated rows repeat theirs, an empty input gives an empty
    result. Without names only initials with a family name are found as names. Columns of other names are ignored.
    """
    given, familiar = _lexicon(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, familiar)
        for batch in batches:
            out = [
                (tbl, rec, s.kind, s.start, s.end)
                for tbl, rec, text in zip(*(batch[c].to_pylist() for c in ("tbl", "rec_id", "text")), strict=True)
                for s in finder.find(text)
            ]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["tbl", "rec_id", "pii_type", "start_pos", "end_pos"])

    return texts.select("tbl", "rec_id", "text").where("text <> ''").mapInArrow(run, "tbl string, rec_id string, pii_type string, start_pos int, end_pos int")


def mask_pii(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` with each occurrence replaced by its type in angle brackets, all else unchanged. Nulls stay null; see find_pii."""
    given, familiar = _lexicon(names)

    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(given, familiar)
        for s in parts:
            yield s.map(finder.mask, na_action="ignore")

    return texts.withColumn("text", F.pandas_udf(masked, "string")(F.col("text")))
