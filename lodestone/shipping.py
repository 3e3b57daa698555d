"""Sending this package to executors, so that Python workers can import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "lodestone"), "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE))
    context.addPyFile(archive)
    context._lodestone_shipped = True
