"""Makes the package known to the Python workers of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package along with the application (once), as ``--py-files`` would, for workers on which it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    _DONE.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    at = tempfile.mkdtemp()
    copy = shutil.copytree(here, os.path.join(at, "all", name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(at, name), "zip", os.path.dirname(copy), name))
