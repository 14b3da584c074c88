"""Mixing sources to target weights.

Each source's words, document after document, are one stream, cut into blocks of BLOCK_WORDS. The mix is a
row of output shards with SHARD_SLOTS block slots each; shards draw their source counts from multinomials whose odds are
the slots that the sources still have to fill, so the totals come out at the targets. The draws form a tree: a run of
shards draws its first half's counts and leaves the second half the rest, with a seed of the run's own, so every task
finds the counts of its shards by itself. The k-th slot of a source takes the block that a pseudorandom permutation of the source's block
numbers gives for k; each pass over the source uses a permutation of its own, so no block is used twice
before all were used once. Slots meet blocks in one join by (source, block), whose keys are even however
large one source is.

Defined cases: a null source is a source of its own, after all others; a null text has no words; a source
without words has target 0; texts of any length are cut into as many blocks as they fill; repeated rows are separate
documents; an empty table gives an empty mix; further columns, whatever their names, are not read by the mix and are
kept by mixed_documents. The driver holds a row for each source.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._shared import WORD, bucket_count, packed, sound, written
from .sharding import mixed

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 16384
#: Shards whose slots one task makes.
SHARDS_A_TASK = 16
ROWS_PER_BUCKET = 4096
SEED = 20240607


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Share sum(sizes) by weight; what exceeds most times a source's size is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1: four Feistel rounds over an even number of bits, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, outside = index.astype(np.uint64), np.arange(len(index))
    while len(outside):
        h, m, k = half[outside], mask[outside], key[outside].astype(np.uint64)
        left, right = out[outside] >> h, out[outside] & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right + k * np.uint64(0x100000001B3) + np.uint64(turn << 40)) & m)
        out[outside] = (left << h) | right
        outside = outside[out[outside] >= size[outside].astype(np.uint64)]
    return out.astype(np.int64)


def place_of(block: int, size: int, key: int) -> int:
    """The index that permuted() sends to this block."""
    half = int(max(1, np.ceil(np.log2(max(size, 2)) / 2)))
    mask, value = (1 << half) - 1, block
    while True:
        left, right = value >> half, value & mask
        for turn in range(3, -1, -1):
            seed = (left + (key * 0x100000001B3) + (turn << 40)) & 0xFFFFFFFFFFFFFFFF
            left, right = right ^ (int(mixed(np.array([seed], dtype=np.uint64))[0]) & mask), left
        value = (left << half) | right
        if value < size:
            return value


def slot_plan(size: int, target: float, key: int, block: int = BLOCK_WORDS, most: int = MOST_REPEATS) -> tuple[int, int]:
    """Slots of a source, and the words that its last slot takes, so that round(target) words are taken in all."""
    want = min(round(target), most * size)
    if not size or not want:
        return 0, block
    blocks, short = -(-size // block), size - (-(-size // block) - 1) * block
    passes, rest = divmod(want, size)
    if not rest:
        return passes * blocks, block
    # The short last block of the stream comes at this place of the pass that is cut.
    at = place_of(blocks - 1, blocks, key + passes)
    if rest <= at * block:
        slots = -(-rest // block)
        return passes * blocks + slots, rest - (slots - 1) * block
    if rest <= at * block + short:
        return passes * blocks + at + 1, rest - at * block
    slots = -(-(rest - at * block - short) // block)
    return passes * blocks + at + 1 + slots, rest - at * block - short - (slots - 1) * block


def drawn(left: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `slots` slots, none above what its source has left."""
    counts = np.zeros_like(left)
    while (open_ := slots - int(counts.sum())) > 0:
        rest = left - counts
        counts += np.minimum(rng.multinomial(open_, rest / rest.sum()), rest)
    return counts


def shard_counts(shard: int, slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each source, count of each source) of an output shard, found from the root of the draws."""
    first, left = np.zeros(len(slots), dtype=np.int64), np.array(slots, dtype=np.int64)
    low, high = 0, -(-int(left.sum()) // shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        half = drawn(left, (middle - low) * shard_slots, np.random.default_rng([seed, low, high]))
        if shard < middle:
            left, high = half, middle
        else:
            first, left, low = first + half, left - half, middle
    return first, left


def word_counts(docs: DataFrame) -> DataFrame:
    """Written: uid, doc_id, source, text_hash, size. uid tells repeated rows apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), size.alias("size"),
        ),
        "mix-sizes",
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized, pieces).

    sized: uid, doc_id, source, text_hash, size, source_size, target. pieces, the mix itself: shard, place (the
    slot in its source), source_no, uid, first (word of the document), words (how many); one document's words
    taken by one slot.
    """
    spark = docs.sparkSession
    sizes = word_counts(docs)
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    keys = [int(mixed(np.array([seed * 1000003 + i]))[0] >> np.uint64(34)) for i in range(len(found))]
    plans = [slot_plan(r["size"], t, k, block) for r, t, k in zip(found, goal, keys)]

    per_source = spark.createDataFrame(
        [(r["source"], i, r["size"], t) for i, (r, t) in enumerate(zip(found, goal))],
        "source string, source_no int, source_size long, target double",
    )
    sized = sizes.join(per_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Where each document lies in its source's stream: sums inside hashed buckets, raised by the buckets before.
    buckets = bucket_count(sizes.count(), ROWS_PER_BUCKET)
    streamed = sized.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        streamed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
        .select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy("source_no", "bucket").orderBy("doc_id", "uid").rowsBetween(W.unboundedPreceding, -1)
    laid = (
        streamed.join(offsets, ["source_no", "bucket"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    blocks = (
        laid.select("source_no", "uid", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        .withColumn("low", F.greatest("start", F.col("block") * block))
        .withColumn("high", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    )

    wanted = [n for n, _ in plans]
    shards = -(-sum(wanted) // SHARD_SLOTS)

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, count = shard_counts(int(shard), wanted, seed=seed)
                yield pd.DataFrame({"shard": shard, "source_no": np.arange(len(wanted)), "first": first, "n": count})[count > 0]

    # A task for so many shards, whatever their rows weigh before their slots are listed.
    tasks = bucket_count(shards, SHARDS_A_TASK)
    counts = spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, source_no long, first long, n long")
    facts = spark.createDataFrame(
        [(i, -(-r["size"] // block), n, last, k) for i, (r, (n, last), k) in enumerate(zip(found, plans, keys))],
        "source_no int, blocks long, slots long, last_words long, key long",
    )

    @F.pandas_udf(T.LongType())
    def block_of(place: pd.Series, count: pd.Series, key: pd.Series) -> pd.Series:
        place, count, key = (x.to_numpy(dtype=np.int64) for x in (place, count, key))
        return pd.Series(permuted(place % count, count, key + place // count))

    slots = (
        counts.join(F.broadcast(facts), "source_no")  # a row for each source
        .withColumn("place", F.explode(F.expr("sequence(first, first + n - 1)")))
        .withColumn("takes", F.when(F.col("place") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block)))
        .withColumn("block", block_of("place", "blocks", "key"))
        .select(F.col("source_no").cast("int").alias("source_no"), "block", "shard", "place", "takes")
    )
    pieces = (
        blocks.join(slots.hint("merge"), ["source_no", "block"])  # both grow with the input: neither may be sent to all tasks
        .withColumn("words", F.least("high", F.col("block") * block + F.col("takes")) - F.col("low"))
        .filter("words > 0")
        .select("shard", "place", "source_no", "uid", (F.col("low") - F.col("start")).alias("first"), "words")
    )
    return sized, pieces


def taken(sized: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document what the mix takes of it."""
    sums = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    return sized.join(sums.hint("merge"), "uid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's columns with text (and n_chars, if there) as the mix takes it: a document's pieces in mix
    order, a line each; documents of which nothing is taken go. Rows alike in id and text become one row."""
    keys = ["id", "no_id", "hash"]
    sized, pieces = mix(docs, **options)
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    cuts = (
        pieces.join(sized.select("uid", *own, F.col("text_hash").alias("hash")), "uid")
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("shard", "place", "uid", "first", "words"))).alias("cuts"))
    )
    # Texts are shuffled once: rows alike meet, and meet their cuts, by the same keys.
    once = docs.select(*own, F.xxhash64("text").alias("hash"), packed(docs).alias("row")).dropDuplicates(keys)

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, first: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, lows, counts in zip(text, first, words):
            at = [m.span() for m in re.finditer(WORD, t)]
            out.append("\n".join(t[at[low][0] : at[low + n - 1][1]] for low, n in zip(lows.tolist(), counts.tolist())))
        return pd.Series(out)

    rows = once.join(cuts, keys).withColumn("new", cut(sound(F.col("row.text")), F.col("cuts.first"), F.col("cuts.words")))
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(c.alias(n) for n, c in kept.items()))
