"""Column names, row types and the fixed values the monitoring rules depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SENSOR_COUNT = 52
SENSORS = [f"sensor_{i:02d}" for i in range(SENSOR_COUNT)]

# Machine states as they appear in the sensor history.
NORMAL = "NORMAL"
BROKEN = "BROKEN"
RECOVERING = "RECOVERING"
MISSING = "MISSING"

# Counter ceiling, queue batch size and time limit, and the windows around a breakdown.
COUNTER_LIMIT = 20
BATCH_SIZE = 20
BATCH_TIMEOUT_MS = 50
EXCLUDE_HOURS_BEFORE = 1
WINDOW_HOURS_BEFORE = 8
WINDOW_HOURS_AFTER = 3

# Where a reading came from.
ORIGIN_BATCH = "api"
ORIGIN_STREAM = "rabbitmq"

# Severity steps (lower bound, colour); below the first step is green.
BASE_COLOUR = "green"
ERROR_STEPS = [(0.3, "orange"), (1.2, "red")]
COUNTER_STEPS = [(5, "yellow"), (10, "orange"), (15, "red")]

# The sensors shown together on each dashboard panel, by value range.
SENSOR_BANDS = {
    "0-42": [0, 6, 7, 8, 9, 10, 12, 13, 15, 18, 39, 41, 42],
    "42-71": [1, 2, 3, 11, 37, 38, 40, 43, 44, 45, 46, 47, 49],
    "71-515": [5, 14, 16, 17, 20, 22, 27, 33, 34, 35, 48, 50, 51],
    "515-922": [4, 19, 21, 23, 24, 25, 26, 28, 29, 30, 31, 32, 36],
}


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def history_schema(sensors: list[str] = SENSORS, scored: bool = False) -> T.StructType:
    """A sensor-history CSV: row index, time text, one double per sensor, state."""
    fields = [
        T.StructField("index", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        *_doubles(sensors),
        T.StructField("machine_status", T.StringType()),
    ]
    if scored:
        fields = fields[1:] + _doubles(["reconstruction_errors"])
    return T.StructType(fields)


def reading_schema(sensors: list[str] = SENSORS) -> T.StructType:
    """One reading as it travels in a message."""
    return T.StructType([T.StructField("machine_id", T.IntegerType()), *_doubles(sensors)])


THRESHOLD_SCHEMA = T.StructType(
    [
        T.StructField("machine_id", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("effective_at", T.TimestampType()),
    ]
)

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("sensor_idx", T.IntegerType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)

WEIGHTS_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# The stored table has one more sensor column than a reading; it is never filled.
MONITORING_SENSORS = [*SENSORS, f"sensor_{SENSOR_COUNT:02d}"]

# The stored table is split by machine_id modulo this number, however many machines there are.
MACHINE_BUCKETS = 16

# An id of the stored table is the writer, its append, and the row within the append, in these bits.
WRITER_BITS, APPEND_BITS, ROW_BITS = 7, 26, 30

MONITORING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("machine_id", T.IntegerType()),
        *_doubles(MONITORING_SENSORS),
        T.StructField("reconstruction_error", T.DoubleType()),
        T.StructField("anomaly", T.BooleanType()),
        T.StructField("anomaly_counter", T.IntegerType()),
        T.StructField("origin", T.StringType()),
    ]
)
