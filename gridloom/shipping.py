"""Send this package to the Python workers, which may not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import gridloom

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    The archive is made on the driver, and Spark's own file server hands it to the executors, new ones included.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(gridloom.__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "gridloom"), "zip", os.path.dirname(home), "gridloom")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
