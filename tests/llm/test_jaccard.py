import random
import re
from collections import Counter

import numpy as np

from quire.llm.jaccard_join import components, join_components, linked, one_of_each, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} - {()}


def brute(rows):
    sets = [(r["doc_id"], plain(r["text"])) for r in rows]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and None not in (sets[i][0], sets[j][0]) and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    x, y = label[i], label[j]
                    label = [y if k == x else k for k in label]
    low = {}
    for (d, s), k in zip(sets, label):
        if d is not None:
            low[k] = min(low.get(k, d), d)
    return Counter((d, len(s), low.get(k) if d is not None else None) for (d, s), k in zip(sets, label))


def check(docs, **options):
    got = Counter(map(tuple, join_components(docs, **options).collect()))
    want = brute(docs.collect())
    assert got == want, (got - want, want - got)


def family(rng, n, copies, edits):
    words = [rng.choice("abcdefgh") * rng.randint(1, 6) + str(rng.randint(0, 99)) for _ in range(n)]
    for _ in range(copies):
        out = list(words)
        for _ in range(rng.randint(0, edits)):
            out[rng.randrange(len(out))] = "edit" + str(rng.randint(0, 10**6))
        yield " ".join(out)


def test_against_brute_force(spark, odd, none, small):
    rng = random.Random(5)
    texts = []
    for n, copies, edits in ((120, 40, 5), (60, 30, 3), (9, 20, 1), (300, 12, 9), (5, 10, 1)):
        texts += family(rng, n, copies, edits)
    passage = " ".join(f"common{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{k}x{i}" for i in range(rng.randint(2, 40))) for k in range(60)]
    texts += texts[:7] + ["one two", "One  TWO", "one two three", None, ""]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    check(made)
    check(made, rounds=0)
    check(odd)
    check(small.filter("doc_id < 400"))
    assert join_components(none).collect() == []


def test_orders_do_not_lose_links():
    rng = random.Random(6)
    for _ in range(400):
        a, b = (t.encode() for t in family(rng, rng.randint(4, 80), 2, 4))
        x, y = shingles(a), shingles(b)
        both = len(np.intersect1d(x, y))
        assert linked(x, y) == (100 * both >= 85 * (len(x) + len(y) - both))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_one_of_each_stays(spark):
    a, b = "alpha beta gamma delta epsilon", "some other words stand here"
    docs = spark.createDataFrame([(5, a, "x"), (3, a, "y"), (3, a, "y"), (4, b, "z"), (6, None, "n"), (7, "", "n"), (None, a, "n")], "doc_id long, text string, node string")
    assert sorted(map(tuple, one_of_each(docs).collect()), key=str) == sorted([(3, a, "y"), (4, b, "z"), (6, None, "n"), (7, "", "n"), (None, a, "n")], key=str)


def test_random_stars_chains_and_passages(spark):
    """Families whose members lie near the threshold, chains of small steps, and passages that many share."""
    import random

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(4):
        base = rng.choices(vocabulary, k=90)
        for _ in range(14):  # a star: edits of one text, some inside the threshold, some not
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(90)] = rng.choice(vocabulary)
            texts.append(own)
        chain = list(base)
        for _ in range(10):  # a chain: each an edit of the one before
            chain = list(chain)
            for _ in range(rng.randint(1, 3)):
                chain[rng.randrange(90)] = rng.choice(vocabulary)
            texts.append(chain)
    passage = rng.choices(vocabulary, k=60)
    texts += [passage + rng.choices(vocabulary, k=rng.randint(2, 20)) for _ in range(40)]
    rng.shuffle(texts)
    sets = [frozenset(zip(t, t[1:], t[2:], t[3:])) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in join_components(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_one_of_each_keeps_any_columns(spark):
    from quire.llm.jaccard_join import one_of_each

    names = ("id", "hash", "row", "_id", "_hash", "_first", "node", "n")
    docs = spark.createDataFrame([(2, "alpha beta gamma delta epsilon", *names), (5, "alpha beta gamma delta epsilon", *names), (None, "alpha beta gamma delta epsilon", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = one_of_each(docs)
    assert rows.columns == docs.columns and sorted(((r["doc_id"], r["_id"], r["hash"]) for r in rows.collect()), key=str) == [(2, "_id", "hash"), (None, "_id", "hash")]
