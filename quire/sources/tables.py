"""Sources: Parquet tables, and documents as ordered blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a table's files that are one task's share of costly rows.
BYTES_A_TASK = 4 << 20


def task_count(rows: DataFrame, bytes_a_task: int = BYTES_A_TASK) -> int:
    """How many tasks the rows are dealt to: by the size that the planner knows, two for each core at least. A file's row
    groups and the session's shuffle partitions do not grow with a table, so a task's time and memory would."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / bytes_a_task))


def raw_files(spark: SparkSession, path: str, most_bytes: int, glob: str = "*.doc*") -> DataFrame:
    """Files up to a size, as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(F.col("length") <= most_bytes)


def line_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, flow_index (from 0), text: a block for each line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("flow_index", "text"))
    return lines.select("doc_id", F.col("flow_index").cast("long").alias("flow_index"), "text")
