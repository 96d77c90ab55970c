"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: tempfile.TemporaryDirectory | None = None

# A table is only broadcast by hint after it was read back with at most this many rows.
BROADCAST_ROWS = 100_000


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites per column expression make wide projections slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors are one process, may do without it.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.TemporaryDirectory(prefix="gaugewell-")
        base = _local_scratch.name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def join_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Fix the rows of a small table by writing it once, and mark it for broadcast if it really is small.

    Every later use sees the same rows, and nothing passes through the driver. Above
    ``limit`` rows the join shuffles (adaptive execution splits skewed keys).
    """
    path = scratch_path(df.sparkSession, "side")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(stored) if stored.count() <= limit else stored
