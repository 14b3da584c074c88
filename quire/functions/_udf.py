"""Arrow functions that need no session when their module is imported, and the package for executors that lack it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _package() -> str:
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    return str(out)


@functools.cache
def _sent(application: str, spark: SparkSession) -> None:
    if not spark.sparkContext.master.startswith("local"):
        spark.sparkContext.addPyFile(_package())


def send_package(spark: SparkSession) -> None:
    """Once an application: the driver serves a zip of this package to its executors."""
    _sent(spark.sparkContext.applicationId, spark)


def arrow(kind: str, arrays: bool = False) -> Callable:
    """A pandas function, or one of Arrow arrays, as a Column function of the given type. It counts as not deterministic, so that the optimizer
    neither copies a call nor moves it into a lambda, where it could not run."""

    def put(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            send_package(SparkSession.active())
            return (F.arrow_udf if arrays else F.pandas_udf)(f, kind).asNondeterministic()(*columns)

        return call

    return put
