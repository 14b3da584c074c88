"""op4 against a plain version: one matrix of all labelled rows, one solve, pooled bins."""

import zlib

import numpy as np
import pytest

from quire.llm import quality_score as q


def pooled(counts, ones):
    """The non-decreasing shares closest to the bins', by the min-max formula over all runs of bins that hold rows."""
    at = np.flatnonzero(counts)
    n, k = counts[at], ones[at]
    cn, ck = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(k)])
    mean = lambda a, b: (ck[b + 1] - ck[a]) / (cn[b + 1] - cn[a])
    return at, np.array([max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])


def test_scores_against_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: np.array(q.statistics(r["text"] or "")) for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 3 for i in rows}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in rows and fold[r["doc_id"]] != 1]
    x = np.array([rows[i] for i, _ in known])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z, y, folds = q.fourier(x, mean, spread), np.array([float(k) for _, k in known]), np.array([fold[i] for i, _ in known])
    penalty = q.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    solve = lambda z, y: np.linalg.solve(z.T @ z + penalty, z.T @ y)
    weights = solve(z, y)
    raw = lambda z, w: np.clip((z @ w + 0.5) / 2, 0, 1)
    crossed = np.where(folds == 0, raw(z, solve(z[folds == 2], y[folds == 2])), raw(z, solve(z[folds == 0], y[folds == 0])))
    bins = np.minimum((crossed * q.BINS).astype(int), q.BINS - 1)
    counts, ones = np.bincount(bins, minlength=q.BINS).astype(float), np.bincount(bins, weights=y, minlength=q.BINS)
    curve = q.isotonic(counts, ones)
    at, shares = pooled(counts, ones)
    runs = np.split(at, np.flatnonzero(np.diff(shares) > 1e-12) + 1)  # the pools
    for run in runs:
        n, k = counts[run].sum(), ones[run].sum()
        assert np.interp((run[0] + run[-1]) / 2, np.arange(q.BINS), curve) == pytest.approx((k + 0.5) / (n + 1), abs=0.02)
    got = {r["doc_id"]: r["score"] for r in q.quality_scores(docs, labels).collect()}
    for i, s in rows.items():
        r = raw(q.fourier(s[None], mean, spread), weights)[0]
        assert got[i] == pytest.approx(0.99 * np.interp(r * q.BINS - 0.5, np.arange(q.BINS), curve) + 0.01 * r, abs=1e-6)
