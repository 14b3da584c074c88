"""Exact top-k inner products by tiles.

Queries are dealt into tiles of a bounded size and written; one tile at a time is sent to all tasks, which multiply it
with their shard of the vectors block by block and keep every query's best of the block, then of the task; the tile's
lists are written before the next tile is read, so the driver and the executors hold one tile at a time. The tasks'
lists are merged in two levels. Components are floor(256 * x); products are exact integers.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors meet
those of equal length only; rows that share a query's id are its own and no candidates of it; where several rows have
a query's id, its best are those over all of them, whatever their order, and a vec_id comes once for each row of the
pair; an empty vector's products are 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import scratch

TOP = 5
EVERY = 50
SCALE = 256
#: Bytes of a tile of queries: all that the driver holds of them, and a broadcast.
TILE_BYTES = 8 << 20
BLOCK_ROWS = 2048
MERGE_WAYS = 64


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and the components, in double, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")
    )


def matrix(vectors: pd.Series) -> np.ndarray:
    """A line of integers, held as doubles, for each vector."""
    return np.floor(SCALE * np.array(vectors.to_list(), dtype=np.float64).reshape(len(vectors), -1))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products of integer-valued doubles: by doubles where all sums fit 53 bits, else by integers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.array([[max(-(2**63), min(2**63 - 1, x)) for x in line] for line in exact], dtype=np.int64)


def best(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Of each line the k highest scores, ties to smaller ids; own ids are left out."""
    by_id = np.argsort(ids, kind="stable")
    ids, scores, n = ids[by_id], scores[:, by_id], len(ids)
    own = ids[None, :] == query_ids[:, None]
    if scores.size and np.abs(scores.astype(np.float64)).max() * n < 2.0**62:
        # Score and place in one number, all different: higher scores first, then smaller ids.
        key = np.where(own, np.iinfo(np.int64).min, scores * n + (n - 1 - np.arange(n)))
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(key), 1))
    else:
        at = np.array([np.lexsort((ids, [-int(x) for x in line], o))[: min(k, n)] for line, o in zip(scores, own)], dtype=np.int64).reshape(len(scores), -1)
    line = np.repeat(np.arange(len(at)), at.shape[1])
    at = at.ravel()
    kept = ~own[line, at]
    return pd.DataFrame({"query_id": query_ids[line[kept]], "vec_id": ids[at[kept]], "score": scores[line[kept], at[kept]]})


def top_products(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k best of all rows but its own."""
    spark = vectors.sparkSession
    rows, asked = whole(vectors), whole(queries).withColumn("n", F.size("v"))
    tiles = {r["n"]: max(1, -(-r["rows"] * (r["n"] + 1) * 8 // TILE_BYTES)) for r in asked.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # a row for each vector length
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not tiles:
        return empty
    # Dealt by row number, so that repeats of an id or of a vector fill no tile.
    number = F.coalesce(*(F.when(F.col("n") == n, F.lit(t)) for n, t in tiles.items()))
    dealt, lists = scratch(spark, "tiles"), scratch(spark, "topk")
    asked.withColumn("tile", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number)).write.partitionBy("n", "tile").parquet(dealt)
    held_tiles = spark.read.schema("vec_id long, v array<double>, n int, tile long").parquet(dealt)
    for n, count in tiles.items():
        shard = rows.filter(F.size("v") == n)
        for tile in range(count):
            held = held_tiles.filter((F.col("n") == n) & (F.col("tile") == tile)).select("vec_id", "v").toPandas()  # about TILE_BYTES
            if held.empty:
                continue
            sent = spark.sparkContext.broadcast((held["vec_id"].to_numpy(np.int64), matrix(held["v"])))
            _tile(shard, sent, k).write.parquet(f"{lists}/part={n}-{tile}")
            sent.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long, task int, part string").parquet(lists)
    order = [F.desc("score"), F.asc("vec_id")]
    first = found.withColumn("way", F.pmod("task", F.lit(MERGE_WAYS))).withColumn("r", F.row_number().over(W.partitionBy("query_id", "way").orderBy(*order))).filter(F.col("r") <= k)
    return (
        first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _tile(rows: DataFrame, tile, k: int) -> DataFrame:
    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries = tile.value
        top: pd.DataFrame | None = None
        for batch in batches:
            for low in range(0, len(batch), BLOCK_ROWS):
                block = batch.iloc[low : low + BLOCK_ROWS]
                ids = block["vec_id"].to_numpy(np.int64)
                new = best(query_ids, products(queries, matrix(block["v"])), ids, k)
                top = new if top is None else _merged(pd.concat([top, new]), k)
        if top is not None:
            yield top

    return rows.mapInPandas(score, "query_id long, vec_id long, score long").withColumn("task", F.spark_partition_id())


def _merged(lists: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = lists.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return ordered[ordered.groupby("query_id").cumcount() < k]


def every_fiftieth(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by `every`."""
    return top_products(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
