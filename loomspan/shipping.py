"""Make this package importable by the Python workers of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context.

    Spark's file server hands it out, so executors need neither the
    repository nor a folder shared with the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomspan_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="loomspan-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    copy = shutil.copytree(root, os.path.join(made, "tree", "loomspan"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(made, "loomspan"), "zip", os.path.dirname(copy)))
    sc._loomspan_shipped = True
