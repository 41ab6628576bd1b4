"""Makes the package importable for Python workers that were not started beside it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once a session, unless their path has it already."""
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.realpath(os.getcwd()) == ROOT or ROOT in paths or getattr(context, "_summitry", False):
        return
    folder = tempfile.mkdtemp(prefix="summitry-")
    shutil.copytree(os.path.join(ROOT, "summitry"), os.path.join(folder, "in", "summitry"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "summitry"), "zip", os.path.join(folder, "in")))
    context._summitry = True
