"""Held-out passages inside a corpus, and the corpus without them.

The items' words go into one generalised suffix automaton. Each document's words are streamed through it, the longest match
that ends at each word is tracked, and where a match of at least ``seed`` words breaks off it is extended in both directions
along the item, over single misread words and page headers. Spans are kept from ``min_words`` words of the item on. Their
places in the text are found again character by character, and remove_leaks cuts them out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.strings import within_one_edit
from sediment.session import cut, small_side

#: A page header standing alone (running title with a page number, or a copy's stamp), a word broken at a line's end, punctuation.
HEADER = re.compile(r"\n[^\S\n]*(?:[^\n|]{1,60}\|[^\n|]{1,60}\|[^\n]{0,6}\d+|Copy \d+ [–-] \d+|[–-] ?\d+ ?[–-])[^\S\n]*(?=\n)")
BROKEN = re.compile(r"(?<=\w)(?:-|­)[^\S\n]*\n\s*(?=[^\W\d_])")
PUNCT = re.compile(r"[^\w\s]|_")


#: Letters that scanning takes for others.
CONFUSED = (("ri", "n"), ("rn", "m"), ("0", "o"), ("1", "l"), ("5", "s"))


@lru_cache(100_000)
def misread(a: str, b: str) -> bool:
    """Whether ``b`` can be ``a`` misread: one edit apart, or the same up to letters that scanning confuses."""
    if within_one_edit(a, b):
        return True
    for old, new in CONFUSED:
        a, b = a.replace(old, new), b.replace(old, new)
    return within_one_edit(a, b)


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation, page headers taken out and words broken over lines joined."""
    if "\n" in text:
        text = BROKEN.sub("", HEADER.sub("\n", text))
    return PUNCT.sub("", text.lower().replace("ß", "ss")).split()


def places_of(text: str) -> list[tuple[int, int]]:
    """First character and end, in the text as it is, of each word of words_of: the same steps, with each character's place kept."""
    at = range(len(text))
    if "\n" in text:
        for pattern, put in ((HEADER, "\n"), (BROKEN, "")):
            kept, last = [], 0
            for m in pattern.finditer(text):
                kept += [at[last : m.start()], at[m.start() : m.start() + len(put)]]
                last = m.end()
            kept.append(at[last:])
            parts, last = [], 0
            for m in pattern.finditer(text):
                parts += [text[last : m.start()], put]
                last = m.end()
            text, at = "".join([*parts, text[last:]]), [i for k in kept for i in k]
    places: list[tuple[int, int]] = []
    inside = False
    for i, c in zip(at, text, strict=True):
        for x in c.lower().replace("ß", "ss"):
            if PUNCT.match(x):
                continue
            if x.isspace():
                inside = False
            elif inside:
                places[-1] = (places[-1][0], i + 1)
            else:
                places.append((i, i + 1))
                inside = True
    return places


class Automaton:
    """Generalised suffix automaton of the items' words: for each state its transitions, suffix link, length and one item's end; ends of all occurrences are spread along the links on demand."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, words_of(t or "")) for i, t in items]
        self.codes: dict[str, int] = {}
        self.seq: list[int] = []
        self.owner: list[tuple[int, int]] = []  # item and place of each word
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end, self.children = [-1], [0], [-1], None
        self.known: dict[int, list[int]] = {}
        last = 0
        self.starts: list[int] = []  # of each item in the sequence
        for k, (_, words) in enumerate(self.items):
            self.starts.append(len(self.seq))
            for p, w in enumerate(words):
                code = self.codes.setdefault(w, len(self.codes))
                self.seq.append(code)
                self.owner.append((k, p))
                last = self._extend(last, code, len(self.seq) - 1)
            last = self._extend(last, -1 - k, -1)  # a separator of its own: no match crosses items
            self.seq.append(-1 - k)
            self.owner.append((k, -1))
        self.kin: dict[int, dict[int, list[tuple[int, list[int]]]]] = {}

    def shared(self, k: int, seed: int) -> list[tuple[int, list[int]]]:
        """Places of item ``k`` at which ``seed`` successive words end that other items have, too, and where they end there: a match with this item may hide theirs."""
        known = self.kin.setdefault(seed, {})
        if k not in known:
            state, out = 0, []
            for p, w in enumerate(self.items[k][1]):
                up = state = self.next[state][self.codes[w]]  # the item's own words are always in the automaton
                while self.length[self.link[up]] >= seed:
                    up = self.link[up]  # the shortest string of at least the seed that ends here has all the ends
                if self.length[up] >= seed and (others := [e for e in self.ends(up) if self.owner[e][0] != k]):
                    out.append((p, others))
            known[k] = out
        return known[k]

    def _extend(self, last: int, code: int, at: int) -> int:
        cur = len(self.next)
        self.next.append({}), self.link.append(0), self.length.append(self.length[last] + 1), self.end.append(at)
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][code]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1), self.end.append(-1)
                while p >= 0 and self.next[p].get(code) == q:
                    self.next[p][code] = twin
                    p = self.link[p]
                self.link[q] = self.link[cur] = twin
        return cur

    def ends(self, state: int) -> list[int]:
        """Places in the sequence where the state's string ends."""
        if state in self.known:
            return self.known[state]
        if self.children is None:
            self.children = [[] for _ in self.next]
            for s, up in enumerate(self.link):
                if up >= 0:
                    self.children[up].append(s)
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            if self.end[s] >= 0:
                out.append(self.end[s])
            todo += self.children[s]
        self.known[state] = out
        return out

    def matches(self, codes: list[int | None], seed: int) -> Iterator[tuple[int, int, int]]:
        """Maximal exact matches of at least ``seed`` words, given as their codes: the place after the last word, the length, the state."""
        nxt, link, length = self.next, self.link, self.length
        state = held = 0
        for at, code in enumerate(codes):
            if code is None:
                if held >= seed:
                    yield at, held, state
                state = held = 0
                continue
            to = nxt[state].get(code)
            if to is None:
                if held >= seed:
                    yield at, held, state
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(code)
                held = length[state]
                if to is None:
                    continue
            state = to
            held += 1
        if held >= seed:
            yield len(codes), held, state

    def spans(self, words: list[str], seed: int, min_words: int) -> list[tuple[int, int, int, int]]:
        """Item, its words matched, first and last word (exclusive) in the document."""
        codes, seq, found = list(map(self.codes.get, words)), self.seq, {}
        size = len(words)
        for at, held, state in self.matches(codes, seed):
            self._extend_match(words, codes, found, at, held, self.ends(state), min_words)
            up = self.link[state]
            if self.length[up] >= seed:
                met = set(self.ends(state))
                while self.length[up] >= seed:  # shorter matches that end here, in other items
                    more = [e for e in self.ends(up) if e not in met]
                    self._extend_match(words, codes, found, at, self.length[up], more, min_words)
                    met.update(more)
                    up = self.link[up]
        for k, runs in [*found.items()]:
            for a, b, c, d in runs:
                for p, others in self.shared(k, seed):
                    if c + seed - 1 <= p < d:
                        for at in range(a + p - c + 1, a + p - c + 2 + max(0, (b - a) - (d - c))):  # a word in two parts moves what follows
                            if codes[at - seed : at] == seq[others[0] - seed + 1 : others[0] + 1]:
                                for e in others:
                                    if self.owner[e][0] not in found:
                                        self._hidden(words, codes, found, at, seed, e, min_words)
        out = []
        for k, runs in found.items():
            n = len(self.items[k][1])
            out += [(self.items[k][0], d - c, a, b) for a, b, c, d in runs if d - c >= min(min_words, n)]
        return out

    def _hidden(self, words: list[str], codes: list[int | None], found: dict, at: int, held: int, e: int, min_words: int) -> None:
        """As _extend_match, for a match that may go on word by word on both sides."""
        seq, size = self.seq, len(codes)
        while at < size and codes[at] == seq[e + 1]:
            at, held, e = at + 1, held + 1, e + 1
        while at > held and e >= held and codes[at - held - 1] is not None and codes[at - held - 1] == seq[e - held]:
            held += 1
        self._extend_match(words, codes, found, at, held, [e], min_words)

    def _extend_match(self, words: list[str], codes: list[int | None], found: dict, at: int, held: int, ends: list[int], min_words: int) -> None:
        """A match of ``held`` words before ``at`` that ends at ``ends`` in the items: grown both ways, into ``found``."""
        seq, size = self.seq, len(words)
        before = at - held - 1
        for e in ends:
            k, p = self.owner[e]
            first, item = e - p, self.items[k][1]
            n, r, left = len(item), p + 1, p - held
            if held < min_words and held < n and not (  # too short, and no way on to either side
                (r < n and at + 1 < size and ((r + 1 < n and codes[at + 1] == seq[first + r + 1]) or words[at] + words[at + 1] == item[r]))
                or (left >= 0 and before >= 1 and ((left >= 1 and codes[before - 1] == seq[first + left - 1]) or words[before - 1] + words[before] == item[left]))
            ):
                continue
            if any(a <= at - 1 < b and c <= p < d for a, b, c, d in found.get(k, ())):
                continue
            right_doc, right = self._grow(words, codes, item, at, first, r, n, 1)
            left_doc, left = self._grow(words, codes, item, before, first, left, n, -1)
            found.setdefault(k, []).append((left_doc + 1, right_doc, left + 1, right))

    def _grow(self, words: list[str], codes: list, item: list[str], at: int, first: int, p: int, n: int, step: int) -> tuple[int, int]:
        """From the next pair of words on: on while they agree, over one misread word if the word after it agrees. Returns the first pair outside."""
        seq, size = self.seq, len(codes)
        while 0 <= p < n and 0 <= at < size:
            if codes[at] == seq[first + p]:
                at, p = at + step, p + step
                continue
            a, q = at + step, p + step
            if 0 <= a < size and 0 <= q < n and codes[a] == seq[first + q] and misread(item[p], words[at]):
                at, p = a, q
            elif step * (size - 1 - at if step > 0 else at) and self._split(words, item, at, p, step):
                at, p = at + 2 * step, p + step
            else:
                break
        return at, p

    @staticmethod
    def _split(words: list[str], item: list[str], at: int, p: int, step: int) -> bool:
        """A word of the item that the document has in two parts."""
        a = at + step
        return 0 <= a < len(words) and (words[at] + words[a] if step > 0 else words[a] + words[at]) == item[p]


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(rows: list[tuple[int, str]], key: str) -> Automaton:
    """The automaton of the items, built once by each worker process, which serves many tasks."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(rows)
    return _AUTOMATA[key]


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 30, seed: int = 7, max_item_words: int = 2_000_000, places: bool = False) -> DataFrame:
    """Passages of held-out items in documents.

    ``docs``: ``id`` and ``text``; ``items``: ``item_id`` and ``item_text``. Returns ``id``, ``item_id``, ``n_words`` (words of the
    item that the passage spans, misread ones included), ``share`` (of the item's words) and ``from_word``, ``to_word`` (place
    in the document's words); with ``places`` also ``from_pos``, ``to_pos`` (in the text, code points) and ``n_doc_words``. Items of
    fewer than ``min_words`` words count when whole.

    A passage is found if ``seed`` successive words of it are undamaged: with ``min_words`` 30 and ``seed`` 7 any with up to
    three misread words in 30. Passages that several items share are found for each of them. Null and empty texts and items
    match nothing; repeated rows come out as often as they stand; empty inputs give an empty result. The items are held by
    every worker: more than ``max_item_words`` words are refused.
    """
    total = items.agg(F.sum(F.size(F.split("item_text", r"\s+")))).first()[0] or 0
    if total > max_item_words:
        raise ValueError(f"{total} words in the items; at most {max_item_words} fit into one automaton")
    rows = [(r.item_id, r.item_text) for r in items.select("item_id", "item_text").where("item_text is not null").orderBy("item_id", "item_text").collect()]  # bounded above
    kept, key = docs.sparkSession.sparkContext.broadcast(rows), hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest()
    names = ["id", "item_id", "n_words", "share", "from_word", "to_word", *(["from_pos", "to_pos", "n_doc_words"] if places else [])]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.int32()] * 5][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(kept.value, key)
        sizes = {i: len(w) for i, w in automaton.items}
        for batch in batches:
            out = []
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = automaton.spans(words_of(text), seed, min_words)
                at = places_of(text) if found and places else []
                out += [(i, item, n, n / sizes[item], a, b, *((at[a][0], at[b - 1][1], len(at)) if places else ())) for item, n, a, b in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = "id bigint, item_id int, n_words int, share double, from_word int, to_word int" + ", from_pos int, to_pos int, n_doc_words int" * places
    return docs.select("id", "text").where("text is not null").mapInArrow(run, schema)


def remove_leaks(docs: DataFrame, items: DataFrame, min_words: int = 30, most_covered: float = 0.5, **how) -> DataFrame:
    """``docs`` (``id`` unique, ``text``) without the passages of held-out items: all columns, and ``removed_chars``.

    Passages of at least ``min_words`` words are cut out, those that overlap as one, and nothing is put in their place. A document
    of which they cover more than ``most_covered`` of the words is dropped. Documents without leaks, null texts included, stay as
    they are. See find_leaks for ``how``. An existing column ``removed_chars`` is replaced.
    """
    found = find_leaks(docs, items, min_words, places=True, **how)
    # of a document only its passages: at most one for each item and 30 words
    cuts = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("from_pos", "to_pos", "from_word", "to_word"))).alias("_c"), F.max("n_doc_words").alias("_n"))

    def merged(low: str, high: str):
        start = F.array().cast("array<struct<a:int,b:int>>")
        last = lambda acc: F.element_at(acc, -1)
        return F.aggregate(
            F.array_sort(F.transform("_c", lambda x: F.struct(x[low].alias("a"), x[high].alias("b")))), start,
            lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.try_element_at(acc, F.lit(-1))["b"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b")))))
            .otherwise(F.concat(acc, F.array(x))),
        )

    length = lambda runs: F.aggregate(runs, F.lit(0), lambda s, x: s + x["b"] - x["a"])
    cuts = cuts.select("id", merged("from_pos", "to_pos").alias("_cut"), (length(merged("from_word", "to_word")) / F.col("_n")).alias("_share"))
    out = docs.drop("removed_chars").join(small_side(cut(cuts)), "id", "left").where(F.coalesce("_share", F.lit(0.0)) <= most_covered)
    starts = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda x: x["b"]))
    ends = F.concat(F.transform("_cut", lambda x: x["a"]), F.array(F.length("text")))
    rest = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr("text", a + 1, b - a)), "")
    out = out.withColumn("removed_chars", F.coalesce(length(F.col("_cut")), F.lit(0))).withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(rest))
    return out.select(*[c for c in docs.columns if c != "removed_chars"], "removed_chars")
