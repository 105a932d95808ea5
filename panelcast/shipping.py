"""Sends the package to the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        base = os.path.join(tempfile.mkdtemp(prefix="run-"), "panelcast")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", _ROOT, "panelcast"))
        _shipped.add(app)
