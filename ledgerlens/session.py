"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def get_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with a fixed zone and adaptive execution; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    On one machine (a local master) a temporary folder stands in for it. On a cluster there is no
    such stand-in: every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="ledgerlens-shared-")
    return _LOCAL[key]


def keep_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has a folder for them."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: later scans read the columns they use."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
