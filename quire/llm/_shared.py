"""What the training-data operators share: the scratch folder, table readers, word patterns."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and words, as Java and Python patterns read them alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Documents per Arrow batch: texts are long, so batches are short.
BATCH_ROWS = 500


#: Folders that written() has made, in order, for dropped().
_made: list[str] = []


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the cluster's shared folder; where none is set, a local master takes one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{_own_folder()}"
    path = f"{root.rstrip('/')}/quire/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for dropped()."""
    return len(_made)


def dropped(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Remove the folders made since the mark, except those that `but` reads."""
    kept = but.inputFiles()
    for path in _made[since:]:
        if not any(path.split("://")[-1] in f for f in kept):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@functools.cache
def _package() -> str:
    """A zip of this package, for executors that do not have it on their path; Spark's driver serves it to them."""
    top = Path(__file__).resolve().parents[1]
    out = Path(_own_folder()) / "quire.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    return str(out)


@functools.cache
def _sent(application: str, spark: SparkSession) -> None:
    spark.sparkContext.addPyFile(_package())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _sent(spark.sparkContext.applicationId, spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of so many rows, for a plan that runs inside; the session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sound(text: Column | str) -> Column:
    """The text as UTF-8: bytes that are none become U+FFFD, so that every reader sees the same text."""
    return F.make_valid_utf8(F.col(text).cast("string") if isinstance(text, str) else text)


def packed(docs: DataFrame) -> Column:
    """A row's columns as one struct, so that working columns may have any name."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))
