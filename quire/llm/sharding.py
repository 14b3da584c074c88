"""Sharding by jump consistent hashing, with gapless slots inside each shard.

The law is `key`: the key and the number of shards decide the shard, no ring table is kept, and one more
shard takes rows only into itself. Equal keys (repeated rows, a hot key) share a shard.

Defined cases: a null key hashes like a fixed key of its own; a null text counts no bytes and has the
checksum of the empty text; texts of any length are summed whole; repeated rows each get a slot; an empty table gives
an empty result; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._shared import bucket_count, text_of

SHARDS = 8
#: Rows numbered together by one window; their count in all grows with the table.
ROWS_PER_BUCKET = 8192
#: The linear congruential step of jump consistent hashing (published constant).
JUMP_STEP = 2862933555777941757
NULL_KEY = 0x6E756C6C


def mixed(keys: np.ndarray) -> np.ndarray:
    """splitmix64, so that consecutive ids do not give related sequences."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; each round moves the keys that still jump."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = mixed(keys)
    shard = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = jump[moving]
        state[moving] = state[moving] * np.uint64(JUMP_STEP) + np.uint64(1)
        spread = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[moving] = np.floor((shard[moving] + 1) * spread).astype(np.int64)
        moving = moving[jump[moving] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(NULL_KEY).cast("long")))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots: rows are spread over hashed buckets inside each shard, numbered in each bucket, and raised by the
    rows of the buckets before, so no task orders a whole shard.
    """
    buckets = bucket_count(docs.count(), ROWS_PER_BUCKET)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    placed = (
        sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
        .withColumn("shard", shard_of(F.col("doc_id"), shards))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    )
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.join(offsets, ["shard", "bucket"])
        .withColumn("slot", F.col("offset") + F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
    )
