"""Prepare, train and evaluate from a sensor history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.scalar import sensor_array
from gaugewell.operators.autoencoder import Weights, reconstruction_error
from gaugewell.operators.failures import breakdown_windows, exclude_before_failure
from gaugewell.operators.prepare import Imputer, by_status, clean
from gaugewell.operators.scaler import Scaler
from gaugewell.operators.selection import not_null
from gaugewell.operators.training import TrainedModel, train_autoencoder
from gaugewell.schema import SENSORS
from gaugewell.session import scratch_path
from gaugewell.sources.readers import read_history, read_history_or_refuse
from gaugewell.sources.writers import write_scaler_version, write_scored, write_weights


@dataclass(frozen=True)
class OfflineRun:
    model: TrainedModel
    imputer: Imputer
    scored: DataFrame


def training_rows(cleaned: DataFrame, exclude: bool = True, machine: str | None = None, **names: str) -> DataFrame:
    """Rows to learn from. ``exclude=False`` trains on everything, failures included."""
    return exclude_before_failure(cleaned, machine=machine, **names) if exclude else cleaned


def evaluate(rows: DataFrame, weights: Weights, scaler: Scaler, sensors: list[str] = SENSORS) -> DataFrame:
    """Append the reconstruction error under training-side scaling to every row."""
    error = reconstruction_error(sensor_array(sensors), weights, scaler, rule="train")
    return rows.withColumn("reconstruction_errors", error)


def _stored(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def breakdown_report(scored: DataFrame, machine: str | None = None, tie: str = "timestamp") -> DataFrame:
    """Scored rows around each breakdown, tagged with the plot series of their state."""
    around = breakdown_windows(not_null(scored), tie=tie, machine=machine)
    return by_status(around)


def error_report(scored: DataFrame) -> DataFrame:
    """Error over time; breakdowns carry their own series."""
    rows = not_null(scored).select("timestamp", "reconstruction_errors", "machine_status")
    return rows.withColumn("is_broken", F.col("machine_status") == "BROKEN")


def run_offline(
    spark: SparkSession,
    history_path: str,
    output_path: str,
    version: str = "0.0.1",
    epochs: int = 10,
    exclude: bool = True,
    partitions: int | None = None,
    sensors: list[str] = SENSORS,
    refuse: bool = False,
) -> OfflineRun:
    """Train on a history, store scaler and weights, score the same history.

    A malformed line is an error, or with ``refuse`` is stored with its reason under ``refused`` and left out.
    """
    # the text is parsed once; medians, scaler, training and scoring read the Parquet copy
    if refuse:
        history, refused = read_history_or_refuse(spark, history_path, sensors)
        refused.write.mode("overwrite").parquet(f"{output_path}/refused")
    else:
        history = _stored(read_history(spark, history_path, sensors), "history")
    imputer = Imputer.fit(history)
    cleaned = clean(history, imputer, scratch_path(spark, "cleaned"))
    learn = training_rows(cleaned, exclude).withColumn("id", F.unix_micros("timestamp"))
    model = train_autoencoder(learn, sensors, epochs=epochs, partitions=partitions)
    write_scaler_version(model.scaler.to_table(spark), version, f"{output_path}/scaler")
    write_weights(model.weights.to_table(spark, version), f"{output_path}/weights")
    scored = evaluate(cleaned, model.weights, model.scaler, sensors)
    write_scored(scored, f"{output_path}/scored")
    return OfflineRun(model, imputer, spark.read.parquet(f"{output_path}/scored"))
