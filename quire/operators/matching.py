"""Joins: references to targets, intervals, sets and bags of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import f1_hundredths


def target_status(xrefs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """valid where the target exists, else missing: a left join with the distinct targets."""
    known = targets.select(*on).distinct().withColumn("_known", F.lit(True))
    return xrefs.join(known, on, "left").withColumn("status", F.when(F.col("_known"), "valid").otherwise("missing")).drop("_known")


def resolved_targets(xrefs: DataFrame, targets: DataFrame, on: list[str], rid: str) -> DataFrame:
    """target and status: valid where the target exists, parent where a sub-figure's figure does (fig1 for fig1a), else missing."""
    known = targets.select(*on, rid).distinct()
    own = known.withColumn("_own", F.lit(True))
    up = known.withColumnRenamed(rid, "_parent").withColumn("_up", F.lit(True))
    parent = F.nullif(F.regexp_extract(rid, "^((?i:fig)[0-9]+)[A-Za-z]$", 1), F.lit(""))
    rows = xrefs.withColumn("_parent", parent).join(own, [*on, rid], "left").join(up, [*on, "_parent"], "left")
    rows = rows.withColumn("target", F.when(F.col("_own"), F.col(rid)).when(F.col("_up"), F.col("_parent")))
    return rows.withColumn("status", F.when(F.col("_own"), "valid").when(F.col("_up"), "parent").otherwise("missing")).drop("_own", "_up", "_parent")


def reverse_references(xrefs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each target's referrers, in order, as often as they refer."""
    return xrefs.groupBy(*key).agg(F.count("*").alias("n_refs"), F.array_join(F.sort_array(F.collect_list(F.col(order))).cast("array<string>"), ",").alias("referrers"))


def token_overlap(left: DataFrame, right: DataFrame, key: str, tokens: str) -> DataFrame:
    """Set and bag F1 of two token arrays by key."""
    pairs = left.select(key, F.col(tokens).alias("a")).join(right.select(key, F.col(tokens).alias("b")), key)
    sets = pairs.select(key, "a", "b", F.array_distinct("a").alias("sa"), F.array_distinct("b").alias("sb"))
    counted = sets.withColumn("set_score", f1_hundredths(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb")))
    counted = counted.withColumn("na", F.size("a")).withColumn("nb", F.size("b"))
    one = pairs.select(key, F.explode("a").alias("t")).groupBy(key, "t").agg(F.count("*").alias("x"))
    two = pairs.select(key, F.explode("b").alias("t")).groupBy(key, "t").agg(F.count("*").alias("y"))
    bag = one.join(two, [key, "t"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("both"))
    return counted.join(bag, key, "left").select(
        key, "set_score", f1_hundredths(F.coalesce("both", F.lit(0)), F.col("na"), F.col("nb")).alias("bag_score"),
        F.when((F.col("na") == 0) & (F.col("nb") == 0), 100).otherwise(F.floor(100 * F.least("na", "nb") / F.greatest("na", "nb"))).cast("long").alias("count_score"),
    )
