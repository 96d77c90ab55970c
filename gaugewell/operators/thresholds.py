"""Per-machine thresholds: newest value, look-up, and the value at reading time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.operators.ordering import carry_value

_KIND = 1 << 61


def latest_thresholds(history: DataFrame, tie: str | None = None) -> DataFrame:
    """Last threshold written per machine. A partial aggregate, so a busy machine costs one row per task."""
    order = F.struct("effective_at", tie) if tie else F.col("effective_at")
    return history.groupBy("machine_id").agg(
        F.max_by("threshold", order).alias("threshold"), F.max("effective_at").alias("effective_at")
    )


def attach_threshold(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add the machine's threshold; NULL where none is known.

    ``thresholds`` has one row per machine. No broadcast hint: Spark broadcasts
    it below ``spark.sql.autoBroadcastJoinThreshold``, and above that splits
    the readings of a dominant machine as a skewed join partition.
    """
    return readings.join(thresholds.select("machine_id", "threshold"), "machine_id", "left")


def without_threshold(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings of machines without a threshold; they are rejected and change no counter."""
    return readings.join(thresholds.select("machine_id"), "machine_id", "left_anti")


def merge_events(readings: DataFrame, history: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Readings and threshold writes in one frame.

    ``is_control`` tells them apart, and ``event_order`` (a whole number) puts
    a threshold write ahead of the readings of the same instant.
    """
    control = history.select(
        "machine_id",
        F.col("effective_at").cast(readings.schema[ts].dataType).alias(ts),
        F.col("threshold").alias("set_threshold"),
        F.lit(True).alias("is_control"),
        F.col(tie).cast("long").alias("event_order"),
    )
    body = readings.withColumns({"is_control": F.lit(False), "event_order": F.lit(_KIND) + F.col(tie).cast("long")})
    return body.unionByName(control, allowMissingColumns=True)


def attach_threshold_asof(
    readings: DataFrame, history: DataFrame, ts: str = "ts", tie: str = "id", **chunking
) -> DataFrame:
    """Add the newest threshold written at or before each reading; NULL before the first."""
    events = merge_events(readings, history, ts, tie)
    filled = carry_value(events, ["machine_id"], ts, "event_order", "set_threshold", "threshold", **chunking)
    return filled.where(~F.col("is_control")).drop("is_control", "event_order", "set_threshold")
