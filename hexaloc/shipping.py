"""Bring the package to Spark's Python workers where they wouldn't find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Add the package to the workers' path, once for each application.

    Nothing is done if it is on PYTHONPATH, installed, or beside the driver's working folder."""
    known = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if os.path.realpath(ROOT) not in known and "site-packages" not in ROOT:
        _add(spark.sparkContext.applicationId)


@lru_cache(8)
def _add(application: str) -> None:
    spark = SparkSession.getActiveSession()
    folder = os.path.realpath(tempfile.mkdtemp())
    archive = shutil.make_archive(os.path.join(folder, f"hexaloc-{application}"), "zip", ROOT, "hexaloc")
    spark.sparkContext.addPyFile(archive)
