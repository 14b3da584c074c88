import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def smallest(rows):
    """The smallest doc_id of each component of links with 5-word Jaccard 0.8 or more."""
    sets = {r["doc_id"]: plain(r["text"]) for r in rows}
    low, ids = {i: i for i in sets}, sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and low[i] != low[j] and a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                both = len(a & b)
                if 10 * both >= 8 * (len(a) + len(b) - both):
                    x, y = sorted((low[i], low[j]))
                    low = {k: x if v == y else v for k, v in low.items()}
    return set(low.values())


def test_stage_takes_five_words_and_four_fifths(spark, small):
    docs = small.filter("doc_id < 300 OR doc_id IN (615, 709, 830, 944, 582, 875)")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()}
    assert kept == smallest(docs.collect())
    assert not kept & {830, 615, 278, 944, 875}
