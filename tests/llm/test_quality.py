"""Quality rules and the quality score."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm.quality_rules import BUCKETS, MIN_SPREAD, PSEUDO, SCALE, SPREADS, kept_documents, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def check(spark, docs, trusted):
    plain = docs.collect()
    ids = {r[0] for r in trusted.collect()} - {None}
    grams = []
    for r in plain:
        words = WORDS.findall(r["text"] or "")
        grams.append([(w, None) for w in words] + list(zip(words, words[1:])))
    known = spark.createDataFrame(sorted({g for x in grams for g in x}, key=str) or [("", None)], "a string, b string")
    pair = F.pmod(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")), F.lit(BUCKETS)) + BUCKETS
    hashed = known.select("a", "b", F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(BUCKETS))).otherwise(pair).alias("k")).collect()
    bucket = {(r["a"], r["b"]): r["k"] for r in hashed}
    n, own = Counter(), Counter()
    for r, g in zip(plain, grams):
        n.update(bucket[x] for x in g)
        if r["doc_id"] in ids:
            own.update(bucket[x] for x in g)
    share = sum(own.values()) / max(1, sum(n.values()))

    def ratio(k, mine):
        if not share:
            return 0
        others = max(n[k] - 1, 0)
        left = max(own[k] - 1, 0) if mine else min(own[k], others)
        x = SCALE * math.log((left + PSEUDO * share) / (share * (others + PSEUDO)))
        return math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)

    scores = [sum(ratio(bucket[x], r["doc_id"] in ids) for x in g) / (SCALE * max(1, len(g))) for r, g in zip(plain, grams)]
    trusted_scores = [s for s, r in zip(scores, plain) if r["doc_id"] in ids and not base(r["text"])[-1]]
    least = -math.inf
    if share and trusted_scores:
        mean = sum(trusted_scores) / len(trusted_scores)
        spread = math.sqrt(sum((s - mean) ** 2 for s in trusted_scores) / len(trusted_scores))
        least = mean - SPREADS * max(spread, MIN_SPREAD)
    got = quality_rules(docs, trusted).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    want = sorted(((r["doc_id"], *base(r["text"]), s) for r, s in zip(plain, scores)), key=str)
    rows = sorted((tuple(r[c] for c in columns) for r in got), key=str)
    assert [r[:7] for r in rows] == [w[:7] for w in want]
    for r, w in zip(rows, want):
        assert r[7] == pytest.approx(w[7], abs=1e-9)
        if abs(r[7] - least) > 1e-3:
            assert r[8] == (not r[6] and r[7] >= least)


def test_rules_against_brute_force(spark, odd, none, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    nobody = spark.createDataFrame([(None,)], "doc_id long")
    check(spark, small, labels)
    check(spark, odd, nobody)
    check(spark, odd, spark.createDataFrame([(0,), (8,), (8,), (None,), (999,)], "doc_id long"))
    assert quality_rules(none, labels).collect() == []
    repeats = [(0, " ".join(map(str, [*range(30), *range(8), 99, *range(1, 9)]))), (1, "a " * 9), (2, "a " * 8), (3, "x\n\nx\n y\nx"), (4, "a b c d e f g h " * 3)]
    check(spark, spark.createDataFrame(repeats, "doc_id long, text string"), nobody)


def test_kept_rows_with_any_columns(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    kept = {r["doc_id"] for r in quality_rules(small, labels).filter("kept").collect()}
    odd = small
    for c in ("_id", "_hash", "_text", "carried", "trusted", "known", "words", "h1", "h2", "h8", "sorted", "lines", "score", "kept", "n_words", "buckets", "a.b"):
        odd = odd.withColumn(c, F.lit(c))
    rows = kept_documents(odd, labels)
    assert rows.columns == odd.columns
    got = rows.collect()
    assert {r["doc_id"] for r in got} == kept and len(got) == len(kept) and {r["_hash"] for r in got} == {"_hash"}
    with pytest.raises(ValueError):
        quality_rules(small, labels, buckets=1 << 30)


def test_scores_tell_held_out_labels(spark, small):
    from quire.llm.quality_score import quality_scores

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95, auc
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_scores_of_odd_tables(spark, odd, none):
    from quire.llm.quality_score import quality_scores

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_scores(odd, labels).count() == odd.count()
    assert quality_scores(none, labels).collect() == []
    unlabelled = quality_scores(odd, labels.filter("false")).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    first, second = (sorted(map(tuple, quality_scores(odd, labels).collect()), key=str) for _ in range(2))
    assert [r[0] for r in first] == [r[0] for r in second] and [r[2] for r in first] == pytest.approx([r[2] for r in second])
