"""Sends the package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows in one Arrow batch, so that a batch of long texts or pages fits a Python worker.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Once a session: a zip of this package through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(root, f"{folder}/in/{os.path.basename(root)}", ignore=shutil.ignore_patterns("__pycache__"))
        # Spark reads the zip when it is added and again when executors ask, so it stays with the session.
        kept = tempfile.mkdtemp(prefix="stockpot-package-")
        sc.addPyFile(shutil.make_archive(f"{kept}/stockpot", "zip", f"{folder}/in"))
    _sent.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and make sure that they can import the package."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
