"""Make this package importable on executors, however the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send the package's modules to the executors of a session, once per context."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if getattr(sc, "_webloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        out = os.path.join(tempfile.mkdtemp(prefix="webloom-code-"), "webloom_code.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(out)
    sc._webloom_shipped = True
