"""Sends this package to the executors, so that functions run there wherever the session was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a Python file of the session's context, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, made, True)
    at = os.path.join(made, "weftline_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("weftline", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(at)
    _sent.add(app)
