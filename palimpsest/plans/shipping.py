"""Python workers must find this package. Where the repository is not on their path already, the session sends it to them."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def _found_by_workers() -> bool:
    root = str(PACKAGE.parent)
    return root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root


def ship(spark: SparkSession) -> None:
    """Once a session: the package as a zip through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SENT or _found_by_workers():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package"), "palimpsest.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
