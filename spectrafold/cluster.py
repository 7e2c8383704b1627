"""Getting the package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "spark.spectrafold.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, for clusters where it is not installed.

    Spark's own file server carries the archive; the driver's temporary copy is not read by executors.
    """
    if spark.conf.get(_SHIPPED, None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="spectrafold-ship-"), "spectrafold.zip")
    with open(path, "wb") as f:
        f.write(archive.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, "yes")
