"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

Statistics of the whole text (lengths, shares of character classes, repetition, markup) are standardised;
cosines of FEATURES random projections approximate a Gaussian kernel over them; the standardised statistics themselves
and a constant stand beside these. Each partition of the
labelled rows sums its part of the normal equations, for two folds; the sums give the weights of all rows,
and for each fold weights of the other, whose out-of-fold scores fit an isotonic calibration over score bins.

Defined cases: a null text is an empty one; labels that are null or of unknown documents teach nothing; a
document labelled twice counts twice; without usable labels of both kinds every score is 0.5; repeated rows
get equal scores; a null doc_id is never held out nor learnt from; texts of any length are read whole; bytes that are
no UTF-8 count as U+FFFD; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import short_batches, sound, written

FEATURES = 256
RIDGE = 1.0
WIDTH = 4.0
BINS = 1000
SEED = 7
HELD_OUT = 1
#: Partial sums of the normal equations are added in this many groups before the last addition.
SUM_WAYS = 32
RARE = re.compile(rb"[^\x20\x09-\x0DA-Za-z\x80-\xff.,;:!?'-]")


def statistics(text: str) -> list[float]:
    """Numbers that describe one text, whatever its language."""
    raw = text.encode("utf-8", "replace")
    words, lines = raw.split(), text.split("\n")
    n, size = len(words), max(1, len(text))
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n) if n else np.zeros(1, dtype=np.int32)
    upper, lower = _upper(raw), len(raw)
    filled = [x for x in lines if x.strip()]
    distinct = len(set(words))
    pairs = set(zip(words, words[1:]))
    rare = RARE.findall(raw)
    digits = sum(raw.count(d) for d in b"0123456789")
    ends = sum(1 for x in filled if x.rstrip()[-1] in ".!?:;\"'")
    return [
        np.log1p(n), np.log1p(len(text)), float(lengths.mean()), float(lengths.std()), float(lengths.max(initial=0)) ** 0.5,
        upper / max(1, lower), digits / size, len(rare) / size, raw.count(b"|") / size * 10, raw.count(b"!") / size * 10, raw.count(b".") / max(1, n), raw.count(b",") / max(1, n),
        distinct / max(1, n), len(pairs) / max(1, n - 1), len(set(filled)) / max(1, len(filled)), np.log1p(len(filled)), n / max(1, len(filled)) / 50,
        ends / max(1, len(filled)), len(zlib.compress(raw, 1)) / max(1, len(raw)), sum(1 for w in words if w[:1].isupper()) / max(1, n),
        sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&")) / max(1, n), sum(raw.count(c) for c in (b"<", b">", b"{", b"}", b"http")) / max(1, n),
    ]


def _upper(raw: bytes) -> int:
    letters = np.frombuffer(raw, dtype=np.uint8)
    return int(((letters >= 65) & (letters <= 90)).sum())


WIDE = len(statistics("a b"))


def projections(features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / WIDTH, (WIDE, features)), rng.uniform(0, 2 * np.pi, features)


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features of each row, with the standardised statistics themselves and a constant beside them."""
    w, b = projections()
    x = np.clip((stats - mean) / spread, -6, 6)
    return np.hstack([np.sqrt(2 / len(b)) * np.cos(x @ w + b), x / 10, np.ones((len(x), 1))])


def with_statistics(docs: DataFrame) -> DataFrame:
    """Written: doc_id, stats."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "stats": [statistics(t or "") for t in batch["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sound("text").alias("text"))
    with short_batches(docs.sparkSession):
        return written(rows.mapInPandas(run, "doc_id long, stats array<double>"), "statistics")


def _sums(labelled: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, np.ndarray]:
    """Normal equations by fold: each partition gives one matrix a fold; groups of them are added, then all."""
    wide = FEATURES + WIDE + 1

    def part(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            z = fourier(np.array(batch["stats"].to_list()), mean, spread)
            for fold in (0, 2):
                own = batch["fold"].to_numpy() == fold
                if own.any():
                    a = np.hstack([z[own], batch["quality"].to_numpy(np.float64)[own, None]])
                    sums[fold] = sums.get(fold, 0) + z[own].T @ a
        from pyspark import TaskContext

        way = TaskContext.get().partitionId() % SUM_WAYS
        yield pd.DataFrame({"fold": list(sums), "way": way, "sums": [s.astype("<f8").tobytes() for s in sums.values()]}, columns=["fold", "way", "sums"])

    def added(group: Iterator[pd.DataFrame]) -> pd.DataFrame:
        total, head = np.zeros(wide * (wide + 1)), None
        for batch in group:
            head = batch.iloc[0] if head is None and len(batch) else head
            for s in batch["sums"]:
                total += np.frombuffer(s, dtype="<f8")
        return pd.DataFrame({"fold": [head["fold"]], "way": [head["way"]], "sums": [total.tobytes()]})

    rows = labelled.mapInPandas(part, "fold int, way int, sums binary").groupBy("fold", "way").applyInPandas(lambda pdf: added(iter([pdf])), "fold int, way int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator():  # 2 * SUM_WAYS matrices at most, one at a time
        out[r["fold"]] = out.get(r["fold"], 0) + np.frombuffer(r["sums"], dtype="<f8").reshape(wide, wide + 1)
    return out


def _ridge(sums: np.ndarray) -> np.ndarray:
    a, y = sums[:, :-1], sums[:, -1]
    penalty = RIDGE * np.eye(len(a))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, y)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins: the non-decreasing share of ones; empty bins are filled between."""
    blocks: list[list[float]] = []
    for n, k, i in zip(counts, ones, range(len(counts))):
        if not n:
            continue
        blocks.append([float(k), float(n), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            k2, n2, _, high = blocks.pop()
            blocks[-1][0] += k2
            blocks[-1][1] += n2
            blocks[-1][3] = high
    middle = [(lo + hi) / 2 for _, _, lo, hi in blocks]
    share = [(k + 0.5) / (n + 1) for k, n, _, _ in blocks]
    return np.interp(np.arange(len(counts)), middle, np.maximum.accumulate(share))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = with_statistics(docs)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)).cast("int")
    stats = stats.withColumn("fold", fold)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    labelled = stats.filter(F.col("fold") != HELD_OUT).join(known, "doc_id")
    facts = labelled.agg(
        *(F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(WIDE)), *(F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(WIDE)),
        F.count("*").alias("n"), F.sum("quality").alias("ones"),
    ).first()
    held_out = F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out")
    if not facts["n"] or facts["ones"] in (0, facts["n"]):
        return stats.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean = np.array([facts[f"m{i}"] for i in range(WIDE)])
    spread = np.maximum(np.array([facts[f"s{i}"] for i in range(WIDE)]), 1e-3)
    sums = _sums(labelled, mean, spread)
    weights = _ridge(sum(sums.values()))
    crossed = {k: _ridge(sums[2 - k]) if 2 - k in sums else weights for k in (0, 2)}

    def binned(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.clip((z @ w + 0.5) / 2, 0, 1)

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series, fold: pd.Series) -> pd.Series:
        z = fourier(np.array(stats.to_list()).reshape(len(stats), -1), mean, spread)
        raw = np.where(fold.to_numpy() == 0, binned(z, crossed[0]), binned(z, crossed[2]))
        return pd.Series(np.minimum((raw * BINS).astype(np.int32), BINS - 1))

    bins = labelled.withColumn("bin", bin_of("stats", "fold")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).collect()  # BINS rows at most
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        counts[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    curve = isotonic(counts, ones)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        raw = binned(fourier(np.array(stats.to_list()).reshape(len(stats), -1), mean, spread), weights)
        # A small share of the raw score keeps the order inside the curve's flat parts.
        return pd.Series(0.99 * np.interp(raw * BINS - 0.5, np.arange(BINS), curve) + 0.01 * raw)

    scored = stats.withColumn("score", score("stats"))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
