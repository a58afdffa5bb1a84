"""Tables that gained columns over time, and scratch folders on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import shared_folder


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """Read all versions of a table; columns a version lacks are null in its rows."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
