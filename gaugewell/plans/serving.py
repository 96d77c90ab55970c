"""Score readings, compare with thresholds, count anomalies, store the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.messages import decode_arrays
from gaugewell.functions.scalar import anomaly_flag, sensor_array
from gaugewell.operators.autoencoder import Weights, reconstruction_error
from gaugewell.operators.counter import DOWN, RESET, UP, bounded_counter
from gaugewell.operators.ordering import carry_value, plan_chunks, row_sequence
from gaugewell.operators.scaler import Scaler
from gaugewell.operators.thresholds import attach_threshold, merge_events
from gaugewell.schema import ORIGIN_BATCH, SENSORS
from gaugewell.session import scratch_path
from gaugewell.sources.readers import read_scaler_version, read_weights
from gaugewell.sources.writers import SEQUENCE, append_monitoring, monitoring_rows, write_scaler_version, write_weights

# Why a reading was refused.
MALFORMED, NO_SCORE, NO_THRESHOLD = "malformed", "no_score", "no_threshold"
# Readings of one request.
REQUEST_BITS = 20
_ROW = "_row"
# Rows that one task may hold in order where they have but a few narrow columns, some 80 bytes.
NARROW_CHUNK_ROWS = 400_000


@dataclass(frozen=True)
class Scorer:
    """A model ready for use; small enough to travel with every task."""

    weights: Weights
    scaler: Scaler
    sensors: tuple[str, ...] = tuple(SENSORS)
    rule: str = "serve"
    on_error: str = "reject"

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str, **options) -> Scorer:
        """The stored model of a version, weights and scaler alike."""
        weights = Weights.from_table(read_weights(spark, f"{path}/weights"), version)
        scaler = Scaler.from_table(read_scaler_version(spark, f"{path}/scaler", version))
        return cls(weights, scaler, **options)

    def save(self, spark: SparkSession, path: str, version: str) -> None:
        write_weights(self.weights.to_table(spark, version), f"{path}/weights")
        write_scaler_version(self.scaler.to_table(spark), version, f"{path}/scaler")

    def __call__(self, readings: DataFrame, name: str = "reconstruction_error") -> DataFrame:
        error = reconstruction_error(sensor_array(self.sensors), self.weights, self.scaler, self.rule, self.on_error)
        return readings.withColumn(name, error)


def _reason(error: str) -> Column:
    return F.when(F.col(error).isNull(), NO_SCORE).when(F.col("threshold").isNull(), NO_THRESHOLD)


def judge(scored: DataFrame, thresholds: DataFrame, error: str = "reconstruction_error") -> DataFrame:
    """Add threshold, anomaly and, where a reading cannot be judged, the ``reason``."""
    joined = attach_threshold(scored, thresholds)
    return joined.withColumns({
        "anomaly": anomaly_flag(F.col(error), F.col("threshold")),
        "reason": _reason(error),
    })


def flag_anomalies(scored: DataFrame, thresholds: DataFrame, error: str = "reconstruction_error") -> DataFrame:
    """Add threshold and anomaly. Readings without threshold or score are left out and move no counter."""
    return judge(scored, thresholds, error).where(F.col("reason").isNull()).drop("reason")


def count_anomalies(flagged: DataFrame, ts: str = "ts", tie: str = "id", start: DataFrame | None = None, **chunking) -> DataFrame:
    """Add the machine's counter after each reading."""
    stepped = flagged.withColumn("step", F.when(F.col("anomaly"), UP).otherwise(DOWN))
    return bounded_counter(stepped, ts=ts, tie=tie, start=start, **chunking).drop("step")


def count_with_history(
    scored: DataFrame,
    history: DataFrame,
    ts: str = "ts",
    tie: str = "id",
    error: str = "reconstruction_error",
    start: DataFrame | None = None,
    **chunking,
) -> DataFrame:
    """Threshold at reading time, anomaly and counter, where writing a threshold sets the counter to 0.

    ``start`` holds (machine_id, threshold, counter) from before the first event.
    """
    counted, _ = judge_with_history(scored, history, ts, tie, error, start, **chunking)
    return counted.where(~F.col("is_control")).drop("is_control", "event_order")


def judge_with_history(
    scored: DataFrame, history: DataFrame, ts: str = "ts", tie: str = "id", error: str = "reconstruction_error", start: DataFrame | None = None, **chunking
) -> tuple[DataFrame, DataFrame]:
    """As ``count_with_history``: the counted readings with the threshold events, and the other readings with the ``reason``."""
    events = merge_events(scored, history, ts, tie)
    known = "set_threshold"
    if start is not None:
        earlier = F.to_timestamp(F.lit("0001-01-01 00:00:00")).cast(scored.schema[ts].dataType)
        opening = start.where(F.col("threshold").isNotNull()).select(
            "machine_id",
            earlier.alias(ts),
            F.col("threshold").alias(known),
            F.lit(True).alias("is_control"),
            F.lit(-1).cast("long").alias("event_order"),
        )
        events = events.unionByName(opening, allowMissingColumns=True)
    chunks = plan_chunks(events, ["machine_id"], ts, "event_order", **chunking)
    here = {"chunks": chunks, "placed": True}
    filled = carry_value(chunks.place(events), ["machine_id"], ts, "event_order", known, "threshold", **here)
    filled = filled.where(F.col("event_order") >= 0)
    reason = F.when(~F.col("is_control"), _reason(error))
    usable = filled.where(reason.isNull())
    refused = filled.withColumn("reason", reason).where(F.col("reason").isNotNull())
    flagged = usable.withColumn(
        "anomaly", F.when(~F.col("is_control"), anomaly_flag(F.col(error), F.col("threshold")))
    ).withColumn("step", F.when(F.col("is_control"), RESET).when(F.col("anomaly"), UP).otherwise(DOWN))
    counters = start.select("machine_id", "counter") if start is not None else None
    counted = bounded_counter(flagged, ts=ts, tie="event_order", start=counters, **here)
    return counted.drop("step", known), refused


def score_batch(readings: DataFrame, scorer: Scorer, thresholds: DataFrame, ts: str = "ts", tie: str = "id", **chunking) -> DataFrame:
    """The whole batch request: score, flag, count.

    Busy machines are looked up in the raw readings, so scoring runs once.
    """
    chunks = plan_chunks(readings, ["machine_id"], ts, tie, **chunking)
    return count_anomalies(flag_anomalies(scorer(readings), thresholds), ts, tie, chunks=chunks)


def batch_response(counted: DataFrame, batch: str = "batch_id", seq: str = "seq") -> DataFrame:
    """One record per request: its errors in order and the counter after its last reading.

    A request arrives as one message, so its list is no longer than that message.
    """
    item = F.struct(F.col(seq), F.col("reconstruction_error").alias("error"), F.col("anomaly_counter").alias("counter"))
    answers = counted.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return answers.select(
        batch,
        F.transform("_items", lambda i: i["error"]).alias("reconstruction_errors"),
        F.element_at("_items", -1)["counter"].alias("anomaly_counter"),
    )


@dataclass(frozen=True)
class Served:
    """What a batch of requests gave."""

    response: DataFrame  # batch_id, reconstruction_errors, anomaly_counter
    rejects: DataFrame  # batch_id, position, machine_id, reason


def serve_batch(
    requests: DataFrame,
    scorer: Scorer,
    thresholds: DataFrame,
    table: str,
    append_id: int,
    origin: str = ORIGIN_BATCH,
    writer: int = 0,
    **chunking,
) -> Served:
    """Answer requests (batch_id, ts, value: a JSON array of readings) and store their readings.

    A request with a malformed reading is refused as a whole; readings without
    score or threshold are refused one by one and move no counter. Bodies are
    decoded and scored once, and the wide rows stored in the shared folder. Judging,
    counting and numbering work on a few narrow columns of them; the wide rows are
    read once more, to be joined with the result and appended.
    """
    spark = requests.sparkSession
    decoded = decode_arrays(requests.select("batch_id", "ts", "value"))
    place = F.when(F.col("position") < 1 << REQUEST_BITS, F.col("position")).otherwise(
        F.raise_error(F.lit(f"a request holds at most {1 << REQUEST_BITS} readings")).cast("int")
    )
    numbered = decoded.withColumns({"id": F.shiftleft(F.col("batch_id"), REQUEST_BITS) + place, _ROW: F.monotonically_increasing_id()})
    readings = _stored(scorer(numbered), "requests")

    chunking = {"min_rows": NARROW_CHUNK_ROWS, **chunking}
    narrow = readings.select(_ROW, "batch_id", "position", "machine_id", "ts", "id", "reconstruction_error", "malformed")
    bad = narrow.where("malformed").select("batch_id").distinct()
    judged = judge(narrow.join(bad, "batch_id", "left_anti"), thresholds)
    usable = judged.where(F.col("reason").isNull()).drop("reason", "malformed", "threshold")
    counted = count_anomalies(usable, chunks=plan_chunks(narrow, ["machine_id"], "ts", "id", **chunking))
    # row numbers of the append, in order of arrival
    arrival = plan_chunks(narrow, [], "ts", "id", **chunking)
    marks = _stored(row_sequence(counted, [], "ts", "id", SEQUENCE, chunks=arrival), "counted")

    wide = readings.select(_ROW, "machine_id", "ts", "reconstruction_error", *SENSORS)
    rows = wide.join(marks.select(_ROW, "anomaly", "anomaly_counter", SEQUENCE), _ROW)
    append_monitoring(monitoring_rows(rows, origin, append_id, ingested_at="ts", writer=writer, numbered=True), table, append_id, writer=writer)

    keys = ["batch_id", "position", "machine_id"]
    refused = narrow.join(bad, "batch_id", "left_semi").select(*keys, F.lit(MALFORMED).alias("reason"))
    lost = judged.where(F.col("reason").isNotNull()).select(*keys, "reason")
    return Served(batch_response(marks, seq="position"), refused.unionByName(lost))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
