"""Sends this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as an archive that Spark fetches from the driver, so that no worker needs the driver's paths."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="tallyrow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, PACKAGE.name), "zip", PACKAGE.parent, PACKAGE.name)
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)
