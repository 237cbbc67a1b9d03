"""Send the package to the executors, whose Python need not have its folder on its path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application: the package as a zip file, which Spark itself hands to every Python worker."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="trajspark-ship-")  # of the driver alone: Spark sends what is in it
    try:
        copy = Path(folder) / "src" / package.name
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(folder) / package.name), "zip", copy.parent))
    except FileExistsError:  # sent under this name already
        pass
    _sent.add(context.applicationId)
