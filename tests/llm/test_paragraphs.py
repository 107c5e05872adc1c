import random

from sediment.llm.paragraphs import paragraph_classes, shingles, split, words_of

SCHEMA = "id bigint, text string, no int, keys string"


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)


def jaccard(a, b):
    x, y = set(shingles(words_of(a))), set(shingles(words_of(b)))
    return len(x & y) / len(x | y)


def test_paragraphs():
    text = "a b\n\n \n\nc\n \t\nd e"
    assert [text[a:b] for a, b in split(text)] == ["a b", "c", "d e"] and split("\n\n--\n\n") == [] and split("") == []


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randrange(20, 60)) for _ in range(30)]

    def damaged(w):
        w = list(w)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    docs = [(i, "\n\n".join(damaged(rng.choice(base)) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    docs += [(100, docs[3][1].upper().replace(" ", ", ")), (101, None), (102, ""), (103, "short one"), (104, "Short, one!"), (105, " ".join(f"z{i}" for i in range(50_000)))]
    got = paragraph_classes(frame(spark, docs)).collect()
    text = {(i, no): t[a:b] for i, t in docs if t for no, (a, b) in enumerate(split(t))}
    assert {(r.id, r.no) for r in got} == set(text) and all(text[r.id, r.no] == dict(docs)[r.id][r.from_pos : r.to_pos] for r in got)
    cls = {(r.id, r.no): (r.first_id, r.first_no) for r in got}
    parent = {k: k for k in text}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(text)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if jaccard(text[a], text[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in keys}
    assert all(want[cls[k]] == want[k] for k in keys)  # never more than the links give
    assert sum(cls[k] == want[k] for k in keys) >= 0.98 * len(keys)
    assert all(r.stays == ((r.first_id, r.first_no) == (r.id, r.no)) for r in got)


def test_a_third_of_equal_paragraphs_and_empty(spark):
    docs = [(i, "the same words stand here in every third ruling of all" if i % 3 == 0 else f"this is ruling number n{i} with words a{i} b{i} c{i} d{i}") for i in range(300)]
    got = paragraph_classes(frame(spark, docs)).collect()
    assert sum(r.stays for r in got) == 201 and {r.first_id for r in got if r.id % 3 == 0} == {0}
    assert paragraph_classes(frame(spark, [])).count() == 0


def test_all_pairs_of_a_large_bucket(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    docs = [(i, " ".join([*common, *(f"{'ab'[i % 2]}{k}" for k in range(rng.randrange(8, 14))), f"e{i}"])) for i in range(90)]
    text = dict(docs)
    links = {(i, k) for i in text for k in text if i < k and jaccard(text[i], text[k]) >= 0.8}
    got = {r.id: r.n_links for r in paragraph_classes(frame(spark, docs), bands=24, rows=1).collect()}
    assert got == {i: sum(i in x for x in links) for i in text} and len(links) < 90 * 89 / 2
    assert got == {r.id: r.n_links for r in paragraph_classes(frame(spark, docs), bands=24, rows=1, small=16).collect()}
