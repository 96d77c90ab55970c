"""Batch sinks. Every writer takes a path the whole cluster can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.scalar import round_to_second
from gaugewell.operators.ordering import row_sequence
from gaugewell.schema import APPEND_BITS, MACHINE_BUCKETS, MONITORING_SCHEMA, ORIGIN_STREAM, ROW_BITS, WRITER_BITS

# The number of a row within its append.
SEQUENCE = "_seq"


def write_scored(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The scored history as Parquet, or as CSV with a header."""
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    writer.format(fmt).save(path)


def write_scaler(statistics: DataFrame, path: str) -> None:
    statistics.coalesce(1).write.mode("overwrite").parquet(path)


def write_scaler_version(statistics: DataFrame, version: str, path: str) -> None:
    """The statistics of a model version, beside those already there."""
    write_weights(statistics.withColumn("version", F.lit(version)), path)


def write_scaler_csv(statistics: DataFrame, path: str) -> None:
    """One line per sensor in sensor order."""
    lines = statistics.orderBy("sensor_idx").coalesce(1)
    lines.select(F.col("min").alias("min_array"), F.col("max").alias("max_array")).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_weights(table: DataFrame, path: str) -> None:
    """Add a model version, or replace it, beside the versions already there."""
    table.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def append_thresholds(history: DataFrame, path: str) -> None:
    history.write.mode("append").parquet(path)


def writer_of(origin: str) -> int:
    """The usual writer number of an origin; further writers of the same table take other numbers."""
    return 1 if origin == ORIGIN_STREAM else 0


def _append_key(writer: int, append_id: int) -> int:
    if not (0 <= writer < 1 << WRITER_BITS and 0 <= append_id < 1 << APPEND_BITS):
        raise ValueError(f"writer {writer} or append {append_id} is out of range")
    return (writer << APPEND_BITS) + append_id


def monitoring_rows(
    scored: DataFrame,
    origin: str,
    append_id: int,
    ingested_at: str | None = None,
    ts: str = "ts",
    tie: str = "id",
    writer: int | None = None,
    numbered: bool = False,
    **chunking,
) -> DataFrame:
    """Rows of the monitoring table, numbered in arrival order within the append.

    ``numbered`` says that column SEQUENCE has these numbers already, from 1.

    ``ingested_at`` names a column with the arrival time; without it the time
    of the job counts, as with a column default. Sensors the rows lack stay NULL.
    Ids of different writers or appends never meet; an append with more rows than
    its range of ids is an error.
    """
    rows = scored if numbered else row_sequence(scored, [], ts, tie, SEQUENCE, **chunking)
    arrived = F.col(ingested_at) if ingested_at else F.current_timestamp()
    first = _append_key(writer_of(origin) if writer is None else writer, append_id) << ROW_BITS
    too_many = F.raise_error(F.lit(f"an append holds at most {1 << ROW_BITS} rows")).cast("long")
    values = {
        "id": F.when(F.col(SEQUENCE) < 1 << ROW_BITS, F.lit(first) + F.col(SEQUENCE)).otherwise(too_many),
        "created_at": round_to_second(arrived),
        "origin": F.lit(origin),
    }

    def stored(field):
        if field.name in values:
            return values[field.name].cast(field.dataType).alias(field.name)
        source = field.name if field.name in scored.columns else "NULL"
        return F.expr(f"CAST({source} AS {field.dataType.simpleString()}) AS {field.name}")

    return rows.select(*[stored(f) for f in MONITORING_SCHEMA.fields])


def append_monitoring(rows: DataFrame, path: str, append_id: int, buckets: int = MACHINE_BUCKETS, writer: int = 0) -> None:
    """Append under the folder of this writer and append; repeating it replaces the same rows.

    Within the append rows go to a fixed number of machine buckets, which is part of
    the folder's name, so that a reader finds it whatever a writer chose. The
    rebalance hint groups a bucket's rows into files of the advisory size and splits
    a bucket that a busy machine made large.
    """
    _append_key(writer, append_id)
    folder = f"{path}/writer={writer}/ingest_batch={append_id}"
    (
        rows.withColumns({"buckets": F.lit(buckets), "machine_bucket": F.pmod(F.col("machine_id"), F.lit(buckets)).cast("int")})
        .hint("rebalance", "machine_bucket")
        .sortWithinPartitions("machine_bucket", "machine_id", "id")
        .write.mode("overwrite")
        .partitionBy("buckets", "machine_bucket")
        .parquet(folder)
    )


def write_monitoring_jdbc(rows: DataFrame, url: str, table: str = "monitoring", **options: str) -> None:
    """Append to a database table; the database fills in id and created_at."""
    body = rows.drop("id", "created_at")
    body.write.format("jdbc").options(url=url, dbtable=table, batchsize="10000", **options).mode("append").save()


def publish_queue(messages: DataFrame, servers: str, topic: str) -> None:
    """JSON texts to a Kafka topic; needs Spark's Kafka package on the class path."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_files(messages: DataFrame, path: str) -> None:
    """JSON texts as line files, for a file-based stream."""
    messages.write.mode("append").text(path)


