"""Dashboard panels as Spark SQL over the monitoring table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.scalar import severity_counter, severity_error
from gaugewell.schema import SENSOR_BANDS

def _panel(spark: SparkSession, table: DataFrame, columns: str, machine_id: int) -> DataFrame:
    query = f"SELECT id, created_at, {columns} FROM {{monitoring}} WHERE machine_id = :machine_id ORDER BY id"
    return spark.sql(query, args={"machine_id": machine_id}, monitoring=table)


def error_panel(spark: SparkSession, table: DataFrame, machine_id: int) -> DataFrame:
    """Reconstruction error over time with its severity colour."""
    rows = _panel(spark, table, "reconstruction_error", machine_id)
    return rows.withColumn("severity", severity_error(F.col("reconstruction_error")))


def counter_panel(spark: SparkSession, table: DataFrame, machine_id: int) -> DataFrame:
    """Anomaly counter over time with its severity colour."""
    rows = _panel(spark, table, "anomaly_counter", machine_id)
    return rows.withColumn("severity", severity_counter(F.col("anomaly_counter")))


def band_panel(spark: SparkSession, table: DataFrame, machine_id: int, band: str) -> DataFrame:
    """The sensors of one value range, one column each."""
    names = ", ".join(f"sensor_{i:02d}" for i in SENSOR_BANDS[band])
    return _panel(spark, table, names, machine_id)


def band_series(table: DataFrame, machine_id: int) -> DataFrame:
    """All bands in long form: one record per reading and sensor, tagged with its band."""
    points = [
        F.struct(F.lit(i).alias("sensor"), F.lit(band).alias("band"), F.col(f"sensor_{i:02d}").alias("value"))
        for band, sensors in SENSOR_BANDS.items()
        for i in sensors
    ]
    rows = table.where(F.col("machine_id") == machine_id)
    return rows.select("id", "created_at", F.inline(F.array(*points)))
