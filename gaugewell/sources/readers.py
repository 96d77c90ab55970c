"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.messages import encode_reading
from gaugewell.functions.scalar import parse_or_zero
from gaugewell.operators.selection import not_null
from gaugewell.schema import MONITORING_SCHEMA, SCALER_SCHEMA, SENSORS, WEIGHTS_SCHEMA, history_schema
from gaugewell.session import scratch_path

# Fixed value: the time text of the sensor history.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    # the schema applies by position; FAILFAST makes a malformed number an error instead of a NULL
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _timestamp():
    return F.to_timestamp("timestamp", TIME_FORMAT)


def read_history(spark: SparkSession, path: str, sensors: list[str] = SENSORS) -> DataFrame:
    """Typed sensor history without its row index; unreadable times are an error."""
    return _csv(spark, path, history_schema(sensors)).drop("index").withColumn("timestamp", _timestamp())


def _judge_history(spark: SparkSession, path: str, sensors: list[str]) -> DataFrame:
    """A history with the ``reason`` to refuse a row and the ``line`` it came from, both NULL for a good row.

    Spark checks only cells of columns that are read, so the whole frame has to be written.
    """
    schema = history_schema(sensors)
    width = len(schema.fields)
    rows = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField("_line", T.StringType())]))
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
    )
    time = F.try_to_timestamp("timestamp", F.lit(TIME_FORMAT))
    outside_quotes = F.regexp_replace("_line", r'"(?:[^"\\]|\\.)*"', "")
    reason = (
        F.when(F.size(F.split(outside_quotes, ",")) != width, "cells")
        .when(F.col("_line").isNotNull(), "number")
        .when(F.col("timestamp").isNotNull() & time.isNull(), "time")
    )
    # a line whose only fault is its time was parsed, so its text is put together again
    again = F.to_csv(F.struct(*[f.name for f in schema.fields]))
    line = F.when(reason.isNotNull(), F.coalesce("_line", again))
    return rows.select(time.alias("timestamp"), *sensors, "machine_status", reason.alias("reason"), line.alias("line"))


def read_history_or_refuse(spark: SparkSession, path: str, sensors: list[str] = SENSORS) -> tuple[DataFrame, DataFrame]:
    """The good rows of a history, as ``read_history`` gives them, and (reason, line) of the others.

    Reasons: ``cells`` (too many or too few of them), ``number`` (a cell that should be one is none),
    ``time`` (an unreadable one); the first that holds is given. Empty cells are NULL and no fault. The
    text is parsed once and written to the shared folder in two partitions, of which each result reads
    its own; nothing is shuffled.
    """
    judged = _judge_history(spark, path, sensors).withColumn("refused", F.col("reason").isNotNull())
    store = scratch_path(spark, "judged_history")
    judged.write.partitionBy("refused").parquet(store)
    found = spark.read.schema(judged.schema).parquet(store)
    good = found.where(~F.col("refused")).drop("reason", "line", "refused")
    return good, found.where("refused").select("reason", "line")


def read_scored_history(spark: SparkSession, path: str, sensors: list[str] = SENSORS) -> DataFrame:
    """A scored history; rows with any NULL are dropped."""
    return not_null(_csv(spark, path, history_schema(sensors, scored=True))).withColumn("timestamp", _timestamp())


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A bounded set of messages, one JSON text per line."""
    return spark.read.text(path)


def stream_messages(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Messages as a stream of text files; ``max_files`` bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_queue(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000) -> DataFrame:
    """Messages from a Kafka topic; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALER_SCHEMA).parquet(path)


def read_scaler_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    table = spark.read.schema(f"{_fields(SCALER_SCHEMA)}, version string").parquet(path)
    return table.where(F.col("version") == version).drop("version")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS_SCHEMA).parquet(path)


def history_messages(spark: SparkSession, path: str, machine_id: int, sensors: list[str] = SENSORS) -> DataFrame:
    """A history as JSON messages of one machine. Cells that are no number are sent as 0."""
    cells = T.StructType([T.StructField(f.name, T.StringType()) for f in history_schema(sensors).fields])
    rows = spark.read.schema(cells).option("header", True).option("enforceSchema", True).csv(path)
    numbers = [parse_or_zero(F.col(s)).alias(s) for s in sensors]
    rows = rows.select(F.lit(machine_id).cast("int").alias("machine_id"), *numbers, "machine_status")
    return rows.select(encode_reading(sensors).alias("value"))


def read_scaler_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column statistics file whose line order is the sensor order.

    The file holds one line per sensor and fits one partition, so the running
    id is the line number.
    """
    lines = _csv(spark, path, "min_array double, max_array double").coalesce(1)
    return lines.select(
        F.monotonically_increasing_id().cast("int").alias("sensor_idx"),
        F.col("min_array").alias("min"),
        F.col("max_array").alias("max"),
    )


def read_monitoring(spark: SparkSession, path: str, machine_id: int | None = None) -> DataFrame:
    """The monitoring table, or one machine of it read from its own bucket folders only.

    The number of buckets is read from the folders, and may differ between appends.
    """
    table = spark.read.schema(f"{_ddl()}, writer int, ingest_batch long, buckets int, machine_bucket int").parquet(path)
    if machine_id is not None:
        own = F.col("machine_bucket") == F.pmod(F.lit(machine_id), F.col("buckets"))
        table = table.where(own & (F.col("machine_id") == machine_id))
    return table.drop("writer", "ingest_batch", "buckets", "machine_bucket")


def read_monitoring_jdbc(spark: SparkSession, url: str, table: str = "monitoring", **options: str) -> DataFrame:
    """The monitoring table in a database; filters and columns are pushed into its query."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def _fields(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def _ddl() -> str:
    return _fields(MONITORING_SCHEMA)
