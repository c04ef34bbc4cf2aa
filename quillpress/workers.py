"""Python workers: how they get this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_SHIPPED: dict[str, SparkContext] = {}


def ship(spark: SparkSession | None = None) -> None:
    """Hand the package to the workers on every host as a zip, once for each Spark context; without a session nothing is done."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or _SHIPPED.get("context") is spark.sparkContext:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillpress-code-")  # of the driver, which serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quillpress.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED["context"] = spark.sparkContext
