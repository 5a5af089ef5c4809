"""Python code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context, so that they need no install of their own."""
    context = spark.sparkContext
    if getattr(context, "_terracadence_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="terracadence-"), "terracadence.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("terracadence", os.path.relpath(full, HERE)))
    context.addPyFile(path)
    context._terracadence_shipped = True
