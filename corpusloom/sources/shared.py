"""Where tables of a run are kept: a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one, on a single machine its temporary folder, on a cluster the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return f"{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below it."""
    return f"{root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
