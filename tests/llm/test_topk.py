import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm.topk import best, every_fiftieth


def brute(rows, k=5):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sound if i % 50 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in sound if i != q and len(v) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [0.5, 0.25]), (550, [1.0, 1.0]), (600, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = brute(rows)
    assert sorted(map(tuple, every_fiftieth(df).collect())) == want
    monkeypatch.setattr("quire.llm.topk.TILE_BYTES", 100)
    assert sorted(map(tuple, every_fiftieth(df).collect())) == want
    assert every_fiftieth(df.filter("false")).collect() == []


def by_sql(rows, k=5):
    """Every row of a query's id against every other id's rows, the best k of them all."""
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in sound if i % 50 == 0}):
        pairs = sorted((-sum(x * y for x, y in zip(a, v)), i) for j, a in sound if j == q for i, v in sound if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(pairs[:k], 1)]
    return out


def test_repeated_query_ids_in_any_order(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("tile", F.lit("y"))
        assert sorted(map(tuple, every_fiftieth(df).collect())) == by_sql(rows)
    monkeypatch.setattr("quire.llm.topk.TILE_BYTES", 30)
    assert sorted(map(tuple, every_fiftieth(df).collect())) == by_sql(rows)


def test_large_numbers_are_exact():
    ids, scores = np.arange(4), np.array([[2**62, 2**62 - 1, 5, 2**62]])
    got = best(np.array([9]), scores, ids, 3)
    assert got["vec_id"].tolist() == [0, 3, 1] and defaultdict(int) is not None
