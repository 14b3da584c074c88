"""Operators over the order of blocks inside a document: all windows are partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _order(doc: str, order: str):
    return W.partitionBy(doc).orderBy(order)


def carried_forward(df: DataFrame, doc: str, order: str, value: Column, out: str) -> DataFrame:
    """The latest non-null value at or before each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_order(doc, order).rowsBetween(W.unboundedPreceding, 0)))


def parent_sections(df: DataFrame, doc: str, order: str, level: str, levels: int = 6) -> DataFrame:
    """parent: the nearest earlier section of a lower level, by one running maximum a level."""
    before = _order(doc, order).rowsBetween(W.unboundedPreceding, -1)
    lower = [F.when(F.col(level) > k, F.max(F.when(F.col(level) == k, F.col(order))).over(before)) for k in range(1, levels)]
    return df.withColumn("parent", F.greatest(*lower) if len(lower) > 1 else lower[0])


def numbered(df: DataFrame, doc: str, order: str, kind: str, out: str) -> DataFrame:
    """The k-th object of its kind in its document."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(doc, kind).orderBy(order)))


def renamed_duplicates(df: DataFrame, doc: str, order: str, name: str, out: str, joiner: str = "-auto") -> DataFrame:
    """The second and later rows of a name get a number."""
    n = F.row_number().over(W.partitionBy(doc, name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(joiner), (n - 1).cast("string"))))


def nearest_within(df: DataFrame, doc: str, order: str, wanted: Column, reach: int, out: str) -> DataFrame:
    """The order of the next wanted row in the following `reach` rows."""
    return df.withColumn(out, F.min(F.when(wanted, F.col(order))).over(_order(doc, order).rowsBetween(1, reach)))


def running_total(df: DataFrame, doc: str, order: str, size: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(size).over(_order(doc, order).rowsBetween(W.unboundedPreceding, 0)))


def best_with_margin(df: DataFrame, key: list[str], score: str, tie: str, least: int = 80, margin: int = 15) -> DataFrame:
    """Each key's best row, its lead over the runner-up, and whether that binds it."""
    w = W.partitionBy(*key).orderBy(F.desc(score), F.asc(tie))
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    lead = F.col(score) - F.coalesce("_next", F.lit(0))
    return ranked.filter("_r = 1").withColumn("lead", lead).withColumn("bound", (F.col(score) >= least) & (lead >= margin)).drop("_r", "_next")


def bound_once(candidates: DataFrame, doc: str, caption: str, target: str, score: str, least: int = 80, margin: int = 15) -> DataFrame:
    """doc, caption, object, score: captions in order take their best object that none before took, if it leads by the
    margin; else object is null and score is that best one's. A null target: a caption without candidates."""
    item = F.struct((-F.col(score)).cast("long").alias("order"), F.col(target).cast("long").alias("object"))
    each = candidates.groupBy(doc, caption).agg(F.sort_array(F.collect_list(F.when(F.col(target).isNotNull(), item))).alias("found"))
    docs = each.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(caption).cast("long").alias("caption"), "found"))).alias("captions"))

    def step(seen: Column, x: Column) -> Column:
        free = F.filter(x["found"], lambda y: ~F.array_contains(seen["used"], y["object"]))
        best, second = (F.coalesce(-F.get(free, F.lit(k))["order"], F.lit(0)) for k in (0, 1))
        mine = F.when((best >= least) & (best - second >= margin), F.get(free, F.lit(0))["object"])
        return F.struct(
            F.when(mine.isNotNull(), F.concat(seen["used"], F.array(mine))).otherwise(seen["used"]).alias("used"),
            F.concat(seen["out"], F.array(F.struct(x["caption"].alias("caption"), mine.alias("object"), best.alias("score")))).alias("out"),
        )

    start = F.struct(F.array().cast("array<long>").alias("used"), F.array().cast("array<struct<caption:long,object:long,score:long>>").alias("out"))
    out = docs.select(doc, F.explode(F.aggregate("captions", start, step, lambda seen: seen["out"])).alias("o"))
    return out.select(doc, F.col("o.caption").alias(caption), F.col("o.object").alias("object"), F.col("o.score").alias("score"))


def retained(jobs: DataFrame, group: str, job: str, age: str, size: str, most_jobs: int, most_bytes: int) -> DataFrame:
    """Greedy retention, newest first: a job that does not fit goes, a later smaller one may stay."""
    item = F.struct(F.col(age).alias("age"), F.col(job).alias("job"), F.col(size).alias("size"))
    # Ranked first, which tasks do before the shuffle: a group gathers no more than the jobs that may stay.
    newest = jobs.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(age), F.desc(job)))).filter(F.col("_r") <= most_jobs)
    ordered = newest.groupBy(group).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))

    def step(seen: Column, x: Column) -> Column:
        fits = seen["used"] + x["size"] <= most_bytes
        return F.struct(
            F.when(fits, seen["used"] + x["size"]).otherwise(seen["used"]).alias("used"),
            F.when(fits, F.concat(seen["kept"], F.array(x["job"]))).otherwise(seen["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    return ordered.select(group, F.explode(F.aggregate("items", start, step, lambda seen: seen["kept"])).alias(job))


def unexpired(jobs: DataFrame, at: str, now, ttl_seconds: int) -> DataFrame:
    """Jobs not older than the time to live at the moment `now`."""
    return jobs.filter(F.col(at) >= F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
