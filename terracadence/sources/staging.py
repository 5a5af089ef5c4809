"""Cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Shuffle files of a query go when it ends; what they led to stands in the checkpoint by then.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(context) -> str:
    """The folder that driver and executors share. One of our own only where all run on this machine (tests)."""
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="terracadence-")


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir, without the shuffle files that led to it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(context))
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
