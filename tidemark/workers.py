"""The package on the executors, for functions that run in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Applications that have the package, with the folder of the archive. Executors may fetch it at any time, so it goes when the driver's Python ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here, there = os.path.dirname(os.path.abspath(__file__)), tempfile.TemporaryDirectory()
    shutil.copytree(here, f"{there.name}/zip/tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{there.name}/tidemark-engine", "zip", f"{there.name}/zip"))
    _shipped[context.applicationId] = there
