"""New files as they come: an extension, the studied system answers requests only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import surface

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, glob: str = "*.doc*", most_files: int = 1000) -> DataFrame:
    """A stream of files (doc_id, name, content), so many a batch at most."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).load(folder)
    return files.select(F.sha2("path", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def convert_new(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> int:
    """Convert all files that have come since the last call, and append them to a Parquet folder by batch; a batch that is
    run again replaces its own rows. Returns how many rows the folder then has."""

    def batch(rows: DataFrame, number: int) -> None:
        columns = ("doc_id", "status", "reason", "title", "jats", "total_score", "grade")
        surface.convert(rows, **options).select(*columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    new_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).count()
