import random

from sediment.llm.leakage import Automaton, find_leaks, misread, places_of, remove_leaks, words_of

RNG = random.Random(4)
VOCAB = [f"w{i}{c}" for i in range(300) for c in "abc"]
ITEMS = [(i, " ".join(RNG.choices(VOCAB, k=60))) for i in range(20)]


def brute(words, items, seed):
    """Longest common runs of at least seed words."""
    best = {}
    for i, text in items:
        w = text.split()
        for p in range(len(w)):
            for q in range(len(words)):
                n = 0
                while p + n < len(w) and q + n < len(words) and w[p + n] == words[q + n]:
                    n += 1
                if n >= seed:
                    best[i] = max(best.get(i, 0), n)
    return best


def test_automaton_against_brute_force():
    a = Automaton(ITEMS)
    for _ in range(30):
        words = []
        for _ in range(4):
            w = RNG.choice(ITEMS)[1].split()
            s = RNG.randrange(40)
            words += w[s : s + RNG.randrange(3, 20)] + RNG.choices(VOCAB, k=4)
        got = {}
        for i, n, *_ in a.spans(words, 7, 7):
            got[i] = max(got.get(i, 0), n)
        want = brute(words, ITEMS, 7)
        assert got.keys() == want.keys() and all(got[k] >= want[k] for k in want)


def test_longest_match_lengths():
    a = Automaton([(1, "x y z x y"), (2, "y z z")])
    assert [(at, n) for at, n, _ in a.matches([a.codes.get(w) for w in "x y z z q y z x y".split()], 1)] == [(3, 3), (4, 3), (9, 4)]


def test_damage_is_tolerated():
    item = "the court below held that the lessor had not measured the warehouse before the tenant moved out and so the claim fails for want of proof and the costs follow that event entirely".split()
    a = Automaton([(1, " ".join(item))])
    bad = [{"measured": "mcasured", "fails": "fai1s", "warehouse": "ware-\nhouse"}.get(w, w) for w in item]
    text = "Intro. " + " ".join(bad[:15]).upper() + ",\n\nABC | X 1/2 | p. 7\n\n" + "\n".join(bad[15:25]) + " " + " ".join(bad[25:]) + ". The end."
    got = a.spans(words_of(text), 5, 30)
    assert [(i, n) for i, n, *_ in got] == [(1, len(item))]
    assert misread("the", "tbe") and misread("den", "deri") and misread("of", "0f") and not misread("seller", "buyer")


def test_frames(spark):
    t = ITEMS[3][1].split()
    docs = [(1, " ".join(t[5:40])), (2, " ".join(t[5:30])), (3, None), (4, ""), (5, "zz " * 200_000 + ITEMS[7][1]), (1, " ".join(t[5:40])), (6, "Ab cd ef, gh!")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "ab CD ef gh"), (3, ITEMS[3][1])], "item_id int, item_text string")
    got = sorted((r.id, r.item_id, r.n_words) for r in find_leaks(df, items, seed=4).distinct().collect())
    assert got == [(1, 3, 35), (5, 7, 60), (6, 97, 4)]
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_items_that_share_passages_are_all_found():
    w = RNG.choices(VOCAB, k=80)
    inside, before = " ".join(w[20:60]), " ".join(["start", *w[30:70]])
    a = Automaton([(1, " ".join(w)), (2, inside), (3, before), (4, " ".join(RNG.choices(VOCAB, k=50)))])
    assert {(i, n) for i, n, *_ in a.spans(["x", *w[10:75], "y"], 7, 30)} == {(1, 65), (2, 40), (3, 40)}
    # the other item's words go on where the longer match ends
    b = Automaton([(1, " ".join(w[:50])), (2, " ".join(w[40:]))])
    assert {i for i, *_ in b.spans(w, 7, 30)} == {1, 2}


def test_brute_force_over_overlapping_items():
    for _ in range(40):
        base = RNG.choices(VOCAB[:40], k=120)
        items = [(i, " ".join(base[(s := RNG.randrange(60)) : s + RNG.randrange(20, 60)])) for i in range(6)]
        words = RNG.choices(VOCAB, k=5) + base[(s := RNG.randrange(50)) : s + RNG.randrange(15, 70)] + RNG.choices(VOCAB, k=5)
        got = {}
        for i, n, *_ in Automaton(items).spans(words, 7, 12):
            got[i] = max(got.get(i, 0), n)
        want = {i: n for i, n in brute(words, items, 7).items() if n >= min(12, len(dict(items)[i].split()))}
        assert want.keys() <= got.keys() and all(got[k] >= n for k, n in want.items())


def test_places_are_those_of_the_words():
    text = "Intro: the Straße — ware-\n house (No. 7),\n\nABC | X 1/2 | p. 7\n\nİstanbul “quoted” a.b.c\n– 12 –\nend_of it"
    words, at = words_of(text), places_of(text)
    assert len(words) == len(at) and [words_of(text[a:b]) for a, b in at if "\n" not in text[a:b]] == [[w] for w, (a, b) in zip(words, at, strict=True) if "\n" not in text[a:b]]
    for _ in range(200):
        t = "".join(RNG.choices("aB1 .,-_|\n –ßİ­x", k=RNG.randrange(60)))
        assert len(words_of(t)) == len(places_of(t)), repr(t)


def test_passages_are_removed(spark):
    t = ITEMS[3][1].split()
    body = " ".join(RNG.choices(VOCAB, k=300))
    docs = [(1, body + ". " + " ".join(t[5:40]).upper() + "! " + body, "a"), (2, " ".join(t), "b"), (3, None, "c"), (4, "", "d"), (5, body, "e"), (6, body + " " + " ".join(t[:20]), "f"), (7, " ".join(t[:35]) + " " + body + " " + " ".join(t), "g")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id bigint, text string, source string, removed_chars int")
    got = {r.id: r for r in remove_leaks(df, spark.createDataFrame(ITEMS, "item_id int, item_text string")).collect()}
    gone = len(" ".join(t[5:40]))
    assert got.keys() == {1, 3, 4, 5, 6, 7} and got[1].text == body + ". ! " + body and got[1].removed_chars == gone and got[1].source == "a"
    assert got[3].text is None and got[4].text == "" and got[5].text == body and got[6].text == docs[5][1] and got[6].removed_chars == 0
    assert got[7].text == " " + body + " " and remove_leaks(df.limit(0), spark.createDataFrame(ITEMS, "item_id int, item_text string")).count() == 0
    assert {r.id for r in remove_leaks(df, spark.createDataFrame(ITEMS, "item_id int, item_text string"), most_covered=1.0).collect()} == set(range(1, 8))
