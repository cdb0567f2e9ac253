"""Put this package's code on the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Add a zip of the package (and of modules beside it that use it) to the session, once."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return
    top = os.path.dirname(_HERE)
    path = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_HERE):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
        for name in sorted(os.listdir(top)):  # modules beside the package, if there are any
            if name.endswith(".py") and not name.startswith("_") and os.path.isfile(os.path.join(top, name)):
                z.write(os.path.join(top, name), name)
    context.addPyFile(path)
    context._newsloom_shipped = True
