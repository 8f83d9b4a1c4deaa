"""Ship this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HOME = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make Python workers of all executors able to import this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkquarry_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HOME.rglob("*.py")):
            z.write(p, f"{_HOME.name}/{p.relative_to(_HOME)}")
    path = os.path.join(tempfile.mkdtemp(), f"{_HOME.name}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)  # Spark's own file server hands it out
    sc._sparkquarry_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage that ships the package before it runs; its first argument is the session."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
