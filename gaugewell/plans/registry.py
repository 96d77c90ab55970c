"""Every operator as a query over the shared test tables, with the SQL that checks it.

The tables hold no pump data, so they play its roles: ``events`` are scored
readings (user = machine, value = error), ``lineitem`` is a wide history of
four sensors per supplier, ``embeddings`` are 52-sensor readings per label, and
``customer`` gives a threshold per machine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions import messages as msg
from gaugewell.functions import scalar as fn
from gaugewell.operators import autoencoder as ae
from gaugewell.operators import prepare, selection
from gaugewell.operators.batching import assign_batches, assign_timed_batches, batch_last_counter
from gaugewell.operators.failures import breakdown_windows, exclude_before_failure, exclude_before_failure_ordered
from gaugewell.operators.ordering import plan_chunks
from gaugewell.operators.scaler import Scaler, scaler_statistics
from gaugewell.operators.thresholds import (
    attach_threshold,
    attach_threshold_asof,
    latest_thresholds,
    without_threshold,
)
from gaugewell.operators.training import full_batch_step, stop_epoch, stop_epochs, train_autoencoder
from gaugewell.plans import offline, panels, serving
from gaugewell.schema import ORIGIN_BATCH, ORIGIN_STREAM, SENSOR_BANDS, SENSORS
from gaugewell.session import scratch_path
from gaugewell.sources import readers, writers
from gaugewell.streaming.monitor import MonitorJob

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}

# Cuts even small test machines into several chunks.
FORCE_SPLIT = {"min_rows": 1, "pieces": 48}


def check(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        CHECKS[name] = Check(prepared, sql)
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: str | Column, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


# --- roles of the test tables -------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "BROKEN")
        .when(F.col("event_type") == "signup", "RECOVERING")
        .otherwise("NORMAL")
    )
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("machine_id"),
        F.col("value").alias("reconstruction_error"),
        status.alias("machine_status"),
    )


READINGS = """readings AS (
  SELECT event_id AS id, ts, user_id AS machine_id, value AS reconstruction_error,
         CASE event_type WHEN 'error' THEN 'BROKEN' WHEN 'signup' THEN 'RECOVERING' ELSE 'NORMAL' END AS machine_status
  FROM events)"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    return customers.select(F.col("c_custkey").alias("machine_id"), (F.abs("c_acctbal") / 100).alias("threshold"))


THRESHOLDS = """thresholds AS (
  SELECT c_custkey AS machine_id, abs(c_acctbal) / 100 AS threshold FROM customer)"""


def some_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of one segment have none, so that look-ups miss."""
    lacking = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return thresholds(spark, sf_dir).join(lacking.select(F.col("c_custkey").alias("machine_id")), "machine_id", "left_anti")


SOME_THRESHOLDS = """thresholds AS (
  SELECT c_custkey AS machine_id, abs(c_acctbal) / 100 AS threshold FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def threshold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("machine_id"),
            F.col("value").alias("threshold"),
            F.col("ts").alias("effective_at"),
            F.col("event_id").alias("id"),
        )
    )


def live_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    return events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("machine_id"),
        F.col("value").alias("reconstruction_error"),
    )


def keyless(rows: DataFrame, key: str = "machine_id") -> DataFrame:
    """Some rows have lost their key; they are a group of their own."""
    return rows.withColumn(key, F.when(F.col("l_linenumber") != 5, F.col(key)))


KEYLESS = "keyless AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 5 THEN machine_id END AS machine_id) FROM wide)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sensors, one of them with NULLs, and one that never reports."""
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("machine_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("sensor_00"),
        F.col("l_extendedprice").alias("sensor_01"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("sensor_02"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("sensor_03"),
        F.lit(None).cast("double").alias("sensor_04"),
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("machine_status"),
    )


WIDE_SENSORS = [f"sensor_{i:02d}" for i in range(5)]
WIDE = """wide AS (
  SELECT l_orderkey, l_linenumber, l_suppkey AS machine_id, l_shipdate AS timestamp,
         l_quantity AS sensor_00, l_extendedprice AS sensor_01,
         CASE WHEN l_linenumber <> 3 THEN l_discount END AS sensor_02,
         nullif(l_tax, 0.0) AS sensor_03, CAST(NULL AS DOUBLE) AS sensor_04,
         nullif(l_returnflag, 'R') AS machine_status
  FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """52 sensors per reading, 0.7 s apart, ten machines."""
    vec = F.col("vec_id")
    started = F.to_timestamp(F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz")
    status = F.when(vec % 50 == 0, "BROKEN").when(vec % 50 <= 3, "RECOVERING").otherwise("NORMAL")
    return _table(spark, sf_dir, "embeddings").select(
        vec.alias("id"),
        (started + F.make_dt_interval(secs=vec * F.lit(0.7).cast("decimal(3,1)"))).alias("ts"),
        F.col("label").alias("machine_id"),
        *[F.expr(f"CAST(embedding[{i}] AS DOUBLE) AS {s}") for i, s in enumerate(SENSORS)],
        status.alias("machine_status"),
    )


_VECTOR_SENSORS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {s}" for i, s in enumerate(SENSORS))
VECTORS = f"""vectors AS (
  SELECT vec_id AS id, TIMESTAMP '2024-01-01' + to_microseconds(vec_id * 700000) AS ts, label AS machine_id,
         {_VECTOR_SENSORS},
         CASE WHEN vec_id % 50 = 0 THEN 'BROKEN' WHEN vec_id % 50 <= 3 THEN 'RECOVERING' ELSE 'NORMAL' END AS machine_status
  FROM embeddings)"""


def formula_weights() -> ae.Weights:
    """Weights that SQL can write down, so that scores can be compared."""

    def layer(n: int, fan_in: int, fan_out: int) -> np.ndarray:
        row, col = np.meshgrid(np.arange(fan_in + 1), np.arange(fan_out), indexing="ij")
        return ((row * 7 + col * 13 + n * 5) % 11 - 5) / 20.0

    return ae.Weights(tuple(layer(n, a, b) for n, (a, b) in enumerate(zip(ae.WIDTHS, ae.WIDTHS[1:]))))


def _sql_layer(n: int, x: str) -> str:
    fan_in, fan_out = ae.WIDTHS[n], ae.WIDTHS[n + 1]

    def weight(row: str) -> str:
        return f"((({row} * 7 + c * 13 + {n * 5}) % 11) - 5) / 20.0::DOUBLE"

    total = f"list_sum(list_transform(range(0, {fan_in}), lambda r: {x}[r + 1] * ({weight('r')}))) + {weight(str(fan_in))}"
    value = f"greatest(0.0, {total})" if n < len(ae.WIDTHS) - 2 else total
    return f"list_transform(range(0, {fan_out}), lambda c: {value})"


SCORED = f"""stats AS (
  SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM (
    SELECT i, min(CAST(embedding[i] AS DOUBLE)) AS lo, max(CAST(embedding[i] AS DOUBLE)) AS hi
    FROM embeddings, range(1, 53) t(i) GROUP BY i)),
x AS (SELECT vec_id AS id, list_transform(range(1, 53), lambda i:
        (CAST(embedding[i] AS DOUBLE) - lo[i]) / CASE WHEN hi[i] = lo[i] THEN 1.0 ELSE hi[i] - lo[i] END) AS x
      FROM embeddings, stats),
h1 AS (SELECT id, x, {_sql_layer(0, "x")} AS h FROM x),
h2 AS (SELECT id, x, {_sql_layer(1, "h")} AS h FROM h1),
h3 AS (SELECT id, x, {_sql_layer(2, "h")} AS h FROM h2),
h4 AS (SELECT id, x, {_sql_layer(3, "h")} AS h FROM h3),
scored AS (SELECT id, list_sum(list_transform(range(1, 53), lambda i: (h[i] - x[i]) * (h[i] - x[i]))) / 52 AS e FROM h4)"""


def scorer(spark: SparkSession, sf_dir: str) -> serving.Scorer:
    return serving.Scorer(formula_weights(), Scaler.fit(vectors(spark, sf_dir)))


def vector_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    level = 1.0 + F.abs("c_acctbal") / 10000
    return customers.select(F.col("c_custkey").cast("int").alias("machine_id"), level.alias("threshold"))


VECTOR_THRESHOLDS = """vthr AS (
  SELECT CAST(c_custkey AS INTEGER) AS machine_id, 1.0 + abs(c_acctbal) / 10000 AS threshold
  FROM customer)"""


def _walk(source: str, step: str = "step") -> str:
    """Recursive counter over ``source(machine_id, rn, step)``, rn counting from 1 per machine."""
    moved = f"CASE s.{step} WHEN 0 THEN 0 WHEN 1 THEN least(20, w.c + 1) ELSE greatest(0, w.c - 1) END"
    return f"""walk(machine_id, rn, c) AS (
  SELECT machine_id, rn, CASE {step} WHEN 1 THEN 1 ELSE 0 END FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.machine_id, s.rn, {moved} FROM walk w JOIN {source} s ON s.machine_id = w.machine_id AND s.rn = w.rn + 1)"""


# --- sources ------------------------------------------------------------------


def _history_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "history")
    rows = wide(spark, sf_dir)
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    index = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("index")
    rows.select(index, text, *WIDE_SENSORS, "machine_status").write.option("header", True).csv(path)
    return path


@check(
    "sensor_csv_scan",
    f"WITH {WIDE} SELECT timestamp, {', '.join(WIDE_SENSORS)}, machine_status FROM wide",
)
def sensor_csv_scan(spark, sf_dir):
    rows = readers.read_history(spark, _history_csv(spark, sf_dir), WIDE_SENSORS)
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


_SQL_FAULT = """CASE WHEN l_orderkey % 7 = 1 THEN 'cells' WHEN l_orderkey % 11 = 2 THEN 'number' WHEN l_orderkey % 5 = 3 THEN 'time' END"""


@check(
    "history_rejects",
    f"""WITH {WIDE}, judged AS (SELECT *, {_SQL_FAULT} AS reason FROM wide)
        SELECT reason, CASE WHEN reason IS NOT NULL THEN CAST(l_orderkey * 8 + l_linenumber AS BIGINT) END AS index,
               {', '.join(f'CASE WHEN reason IS NULL THEN {c} END AS {c}' for c in ['timestamp', *WIDE_SENSORS, 'machine_status'])}
        FROM judged""",
)
def history_rejects(spark, sf_dir):
    order = F.col("l_orderkey")
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    damaged = wide(spark, sf_dir).select(
        (order * 8 + F.col("l_linenumber")).alias("index"),
        F.when(order % 5 == 3, F.concat(F.lit("on "), text)).otherwise(text).alias("timestamp"),
        F.when(order % 11 == 2, "n/a").otherwise(F.col(WIDE_SENSORS[0]).cast("string")).alias(WIDE_SENSORS[0]),
        *WIDE_SENSORS[1:],
        F.when(order % 7 == 1, F.concat(F.coalesce("machine_status", F.lit("")), F.lit(",more"))).otherwise(F.col("machine_status")).alias("machine_status"),
    )
    path = scratch_path(spark, "damaged_history")
    # without quotes, a comma in a cell makes two of it
    damaged.write.option("header", True).option("quote", "").csv(path)
    rows, refused = readers.read_history_or_refuse(spark, path, WIDE_SENSORS)
    index = F.split("line", ",")[0].cast("long").alias("index")
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return rows.unionByName(refused.select("reason", index), allowMissingColumns=True)


@check(
    "scored_csv_scan",
    f"""WITH {WIDE} SELECT timestamp, sensor_00, sensor_02, sensor_03, machine_status, sensor_01 AS reconstruction_errors
        FROM (SELECT * REPLACE (timestamp + to_microseconds(l_orderkey % 1000000) AS timestamp) FROM wide)
        WHERE sensor_02 IS NOT NULL AND sensor_03 IS NOT NULL AND machine_status IS NOT NULL""",
)
def scored_csv_scan(spark, sf_dir):
    sensors = ["sensor_00", "sensor_02", "sensor_03"]
    path = scratch_path(spark, "scored")
    exact = (F.col("timestamp") + F.make_dt_interval(secs=(F.col("l_orderkey") % 1_000_000) * F.lit("0.000001").cast("decimal(7,6)"))).alias("timestamp")
    rows = wide(spark, sf_dir).select(exact, *sensors, "machine_status", F.col("sensor_01").alias("reconstruction_errors"))
    writers.write_scored(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path, "csv")
    back = readers.read_scored_history(spark, path, sensors)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


PROPS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("absent", T.DoubleType())])


@check(
    "json_readings",
    """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(0 AS DOUBLE) AS absent FROM events""",
)
def json_readings(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value"))
    return msg.accepted(msg.decode_messages(events, schema=PROPS)).select("id", "k", "absent")


# Of 20 payloads these are spoiled: cut off, wrong type, a second object, text behind, NaN, too large, single quotes.
_SPOILT = {
    3: "substr(props, 1, 5)", 7: """'{"k": "n"}'""", 8: "concat(props, props)", 11: "concat(props, ' garbage')", 13: """'{"absent": NaN}'""",
    14: """'{"absent": 1e999}'""", 15: """'{"absent": "NaN"}'""", 16: "replace(props, '\"', chr(39))", 17: "concat(props, ',', props)",
}
_SPOILT_TEXT = " ".join(f"WHEN {k} THEN {text}" for k, text in _SPOILT.items())


def _spoiled(spark, sf_dir):
    text = F.expr(f"CASE event_id % 20 {_SPOILT_TEXT} ELSE props END")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", text.alias("value"))


@check(
    "json_rejects",
    f"""SELECT event_id AS id, ts, CASE event_id % 20 {_SPOILT_TEXT} END AS value
       FROM events WHERE event_id % 20 IN ({', '.join(map(str, _SPOILT))})""",
)
def json_rejects(spark, sf_dir):
    return msg.rejects(msg.decode_messages(_spoiled(spark, sf_dir), schema=PROPS))


@check(
    "json_strict_batch",
    """WITH b AS (SELECT event_id AS id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS BIGINT) AS batch_id, props,
                         event_id % 97 = 5 AS bad FROM events)
       SELECT id, batch_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM b
       WHERE batch_id NOT IN (SELECT batch_id FROM b WHERE bad)""",
)
def json_strict_batch(spark, sf_dir):
    text = F.when(F.col("event_id") % 97 == 5, F.lit("{invalid json}")).otherwise(F.col("props"))
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", text.alias("value"))
    decoded = msg.decode_messages(assign_batches(events), schema=PROPS)
    return msg.strict_batches(decoded).select("id", "batch_id", "k")


_ROUND_TRIP = SENSORS


@check(
    "publish_json",
    f"""WITH {VECTORS} SELECT id, CAST(7 AS INTEGER) AS machine_id, {', '.join(_ROUND_TRIP)}, machine_status FROM vectors""",
)
def publish_json(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("machine_id", F.lit(7))
    texts = rows.select("id", msg.encode_reading().alias("value"))
    schema = T.StructType([*msg.reading_schema().fields, T.StructField("machine_status", T.StringType())])
    parsed = F.from_json("value", schema)
    return texts.select("id", *[parsed[c].alias(c) for c in ["machine_id", *_ROUND_TRIP, "machine_status"]])


@check(
    "json_array_explode",
    f"""WITH {VECTORS}, s AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS n FROM vectors)
        SELECT CAST(n // 20 AS BIGINT) AS batch_id, CAST(n % 20 AS INTEGER) AS position, machine_id,
               {', '.join(_ROUND_TRIP)} FROM s""",
)
def json_array_explode(spark, sf_dir):
    bodies = msg.encode_batches(assign_batches(vectors(spark, sf_dir)))
    back = msg.accepted(msg.decode_arrays(bodies.withColumnRenamed("body", "value")))
    return back.select("batch_id", "position", "machine_id", *_ROUND_TRIP)


# --- cleaning -----------------------------------------------------------------


@check(
    "feature_project",
    f"""WITH {VECTORS} SELECT id, machine_status, CAST(52 AS INTEGER) AS width, sensor_00 AS first_value, sensor_51 AS last_value,
        round({' + '.join(SENSORS)}, 6) AS total FROM vectors""",
)
def feature_project(spark, sf_dir):
    x = F.col("features")
    return prepare.features(vectors(spark, sf_dir)).select(
        "id",
        "machine_status",
        F.size(x).alias("width"),
        x[0].alias("first_value"),
        x[51].alias("last_value"),
        _r(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), "total"),
    )


@check(
    "status_split",
    f"""WITH {READINGS} SELECT id, ts AS timestamp, reconstruction_error AS reconstruction_errors, machine_status,
        lower(machine_status) AS series FROM readings""",
)
def status_split(spark, sf_dir):
    rows = readings(spark, sf_dir).select(
        "id", F.col("ts").alias("timestamp"), F.col("reconstruction_error").alias("reconstruction_errors"), "machine_status"
    )
    return prepare.by_status(rows)


@check(
    "error_report",
    f"""WITH {READINGS} SELECT ts AS timestamp, reconstruction_error AS reconstruction_errors, machine_status,
        machine_status = 'BROKEN' AS is_broken FROM readings""",
)
def error_report(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumnsRenamed({"ts": "timestamp", "reconstruction_error": "reconstruction_errors"})
    return offline.error_report(rows)


@check(
    "drop_null_rows",
    f"""WITH {WIDE} SELECT l_orderkey, l_linenumber, sensor_00, sensor_01, sensor_02, sensor_03, machine_status FROM wide
        WHERE sensor_02 IS NOT NULL AND sensor_03 IS NOT NULL AND machine_status IS NOT NULL""",
)
def drop_null_rows(spark, sf_dir):
    rows = wide(spark, sf_dir).select("l_orderkey", "l_linenumber", *WIDE_SENSORS[:4], "machine_status")
    return selection.not_null(rows)


_SQL_MEDIANS = " UNION ALL ".join(
    f"SELECT '{s}' AS \"column\", count({s}) AS n, round(median({s}), 6) AS median FROM wide" for s in WIDE_SENSORS
)


@check("column_medians", f"WITH {WIDE} {_SQL_MEDIANS}")
def column_medians(spark, sf_dir):
    return selection.exact_medians(wide(spark, sf_dir), WIDE_SENSORS).select("column", "n", _r("median"))


@check(
    "column_medians_by_machine",
    f"WITH {WIDE}, {KEYLESS} "
    + " UNION ALL ".join(
        f"SELECT machine_id, '{s}' AS \"column\", round(median({s}), 6) AS median FROM keyless GROUP BY machine_id"
        for s in WIDE_SENSORS
    ),
)
def column_medians_by_machine(spark, sf_dir):
    medians = selection.exact_medians(keyless(wide(spark, sf_dir)), WIDE_SENSORS, ["machine_id"])
    return medians.select("machine_id", "column", _r("median"))


@check(
    "impute_median",
    f"""WITH {WIDE} SELECT l_orderkey, l_linenumber, timestamp,
        {', '.join(f'round(coalesce({s}, (SELECT median({s}) FROM wide), 0.0), 6) AS {s}' for s in WIDE_SENSORS)},
        coalesce(machine_status, 'MISSING') AS machine_status FROM wide""",
)
def impute_median(spark, sf_dir):
    rows = wide(spark, sf_dir)
    imputer = prepare.Imputer.fit(rows.select(*WIDE_SENSORS))
    filled = imputer.transform(rows.drop("machine_id"))
    return filled.select("l_orderkey", "l_linenumber", "timestamp", *[_r(s) for s in WIDE_SENSORS], "machine_status")


@check(
    "impute_by_machine",
    f"""WITH {WIDE}, {KEYLESS}, m AS (SELECT machine_id AS m, {', '.join(f'median({s}) AS m_{s}' for s in WIDE_SENSORS)} FROM keyless GROUP BY machine_id)
        SELECT l_orderkey, l_linenumber, {', '.join(f'round(coalesce({s}, m_{s}, 0.0), 6) AS {s}' for s in WIDE_SENSORS)}
        FROM keyless JOIN m ON machine_id IS NOT DISTINCT FROM m""",
)
def impute_by_machine(spark, sf_dir):
    rows = keyless(wide(spark, sf_dir)).select("l_orderkey", "l_linenumber", "machine_id", *WIDE_SENSORS)
    filled = prepare.impute_by(rows, WIDE_SENSORS, ["machine_id"])
    return filled.select("l_orderkey", "l_linenumber", *[_r(s) for s in WIDE_SENSORS])


_AUDITED = [*WIDE_SENSORS, "machine_status"]


@check(
    "null_audit",
    f"""WITH {WIDE} SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in _AUDITED)},
        CAST({' + '.join(f'(count(*) - count({c}))' for c in _AUDITED)} AS BIGINT) AS total_nulls FROM wide""",
)
def null_audit(spark, sf_dir):
    return prepare.null_audit(wide(spark, sf_dir), _AUDITED)


_TEXT_SQL = """CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN ' 1.5 ' WHEN 3 THEN '1.5d' WHEN 4 THEN '1e999'
  WHEN 5 THEN '-.5' WHEN 6 THEN '+3.e2' ELSE CAST(value AS VARCHAR) END"""


@check(
    "parse_or_zero",
    f"""WITH t AS (SELECT event_id AS id, {_TEXT_SQL} AS txt FROM events)
        SELECT id, CASE WHEN regexp_full_match(txt, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                         AND txt <> '1e999' THEN CAST(txt AS DOUBLE) ELSE 0.0::DOUBLE END AS parsed FROM t""",
)
def parse_or_zero(spark, sf_dir):
    events = _table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{_TEXT_SQL.replace('VARCHAR', 'STRING')} AS txt")
    return events.select("id", fn.parse_or_zero(F.col("txt")).alias("parsed"))


@check(
    "created_at_round",
    "SELECT event_id AS id, make_timestamp(((epoch_us(ts) + 500000) // 1000000) * 1000000) AS created_at FROM events",
)
def created_at_round(spark, sf_dir):
    rounded = fn.round_to_second(F.col("ts")).cast("timestamp_ntz")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), rounded.alias("created_at"))


def _sql_exclusion(hours: int, machine: bool) -> str:
    same = "b.machine_id = r.machine_id AND" if machine else ""
    return f"""WITH {READINGS} SELECT id, ts, machine_id, reconstruction_error FROM readings r
      WHERE machine_status = 'NORMAL' AND NOT EXISTS (SELECT 1 FROM readings b WHERE {same} b.machine_status = 'BROKEN'
        AND r.ts BETWEEN b.ts - INTERVAL {hours} HOUR AND b.ts)"""


def _excluding(hours: int, machine: str | None, ordered: bool = False, **chunking) -> Query:
    def run(spark, sf_dir):
        rows = readings(spark, sf_dir)
        if ordered:
            kept = exclude_before_failure_ordered(rows, "ts", machine=machine, hours=hours, **chunking)
        else:
            kept = exclude_before_failure(rows, "ts", machine=machine, hours=hours)
        return kept.select("id", "ts", "machine_id", "reconstruction_error")

    return run


check("prefailure_exclude", _sql_exclusion(12, True))(_excluding(12, "machine_id"))
check("prefailure_exclude_hour", _sql_exclusion(1, True))(_excluding(1, "machine_id"))
check("prefailure_exclude_global", _sql_exclusion(1, False))(_excluding(1, None))
check("prefailure_exclude_window", _sql_exclusion(12, True))(_excluding(12, "machine_id", ordered=True))
check("prefailure_exclude_window_split", _sql_exclusion(1, False))(_excluding(1, None, ordered=True, **FORCE_SPLIT))


@check(
    "breakdown_windows",
    f"""WITH {READINGS}, b AS (SELECT machine_id, ts AS breakdown_at, row_number() OVER (PARTITION BY machine_id ORDER BY ts, id) AS breakdown_nb
          FROM readings WHERE machine_status = 'BROKEN')
        SELECT r.id, r.ts, r.machine_id, r.machine_status, b.breakdown_nb, b.breakdown_at FROM readings r JOIN b
          ON r.machine_id = b.machine_id AND r.ts BETWEEN b.breakdown_at - INTERVAL 8 HOUR AND b.breakdown_at + INTERVAL 3 HOUR""",
)
def breakdown_windows_query(spark, sf_dir):
    found = breakdown_windows(readings(spark, sf_dir), "ts", machine="machine_id")
    return found.select("id", "ts", "machine_id", "machine_status", "breakdown_nb", "breakdown_at")


@check(
    "stratified_split",
    """SELECT id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), '42')), id)
          <= round(0.3 * count(*) OVER (PARTITION BY event_type)) AS is_test
       FROM (SELECT event_id AS id, nullif(event_type, 'error') AS event_type FROM events)""",
)
def stratified_split(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.nullif("event_type", F.lit("error")).alias("event_type"))
    return selection.stratified_split(events, "event_type", "id")


# --- scaling and scoring ------------------------------------------------------

_SCALED = ["sensor_00", "sensor_01", "sensor_05", "sensor_06"]


def _scalable(spark, sf_dir):
    """Two live sensors, one constant, one with NaN in it."""
    rows = wide(spark, sf_dir).select("l_orderkey", "l_linenumber", "sensor_00", "sensor_01", F.col("sensor_00").alias("sensor_06"))
    spoiled = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("sensor_06"))
    return rows.withColumns({"sensor_05": F.lit(3.5), "sensor_06": spoiled})


SCALABLE = f"""{WIDE}, scalable AS (SELECT l_orderkey, l_linenumber, sensor_00, sensor_01, CAST(3.5 AS DOUBLE) AS sensor_05,
  CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE sensor_00 END AS sensor_06 FROM wide)"""
_RANGES = ", ".join(
    f"min({s}) FILTER (NOT isnan({s})) AS lo{i}, max({s}) FILTER (NOT isnan({s})) AS hi{i}" for i, s in enumerate(_SCALED)
)


@check(
    "scaler_fit",
    f"WITH {SCALABLE} "
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS sensor_idx, min({s}) FILTER (NOT isnan({s})) AS min, "
        f"max({s}) FILTER (NOT isnan({s})) AS max FROM scalable"
        for i, s in enumerate(_SCALED)
    ),
)
def scaler_fit(spark, sf_dir):
    path = scratch_path(spark, "scaler")
    writers.write_scaler(scaler_statistics(_scalable(spark, sf_dir), _SCALED), path)
    return readers.read_scaler(spark, path)


def _sql_scaled(rule: str) -> str:
    def one(i: int, s: str) -> str:
        if rule == "serve":
            return f"round(({s} - lo{i}) / CASE WHEN hi{i} = lo{i} THEN 1.0 ELSE hi{i} - lo{i} END, 6) AS {s}"
        return f"CASE WHEN isnan({s}) OR hi{i} = lo{i} THEN 0.0::DOUBLE ELSE round(({s} - lo{i}) / (hi{i} - lo{i}), 6) END AS {s}"

    scaled = ", ".join(one(i, s) for i, s in enumerate(_SCALED))
    if rule == "serve":
        scaled = scaled.replace("AS sensor_06", "AS raw_06")
        scaled += ", isnan(sensor_06) AS nan_06"
        scaled = f"{scaled}"
    return f"WITH {SCALABLE}, stats AS (SELECT {_RANGES} FROM scalable), o AS (SELECT l_orderkey, l_linenumber, {scaled} FROM scalable, stats) " + (
        "SELECT l_orderkey, l_linenumber, sensor_00, sensor_01, sensor_05, CASE WHEN nan_06 THEN -1.0::DOUBLE ELSE raw_06 END AS sensor_06 FROM o"
        if rule == "serve"
        else "SELECT * FROM o"
    )


@check("scale_train", _sql_scaled("train"))
def scale_train(spark, sf_dir):
    rows = _scalable(spark, sf_dir)
    scaled = Scaler.fit(rows, _SCALED).transform(rows, _SCALED, "train")
    return scaled.select("l_orderkey", "l_linenumber", *[_r(s) for s in _SCALED])


@check("scale_serve", _sql_scaled("serve"))
def scale_serve(spark, sf_dir):
    rows = _scalable(spark, sf_dir)
    scaled = Scaler.fit(rows, _SCALED).transform(rows, _SCALED, "serve")
    shown = F.nanvl("sensor_06", F.lit(-1.0)).alias("sensor_06")  # NaN passes through; shown as -1 to compare
    return scaled.withColumn("sensor_06", shown).select("l_orderkey", "l_linenumber", *[_r(s) for s in _SCALED])


@check(
    "row_mse",
    """SELECT vec_id AS id, round(list_sum(list_transform(range(1, 53), lambda i:
         (CAST(embedding[i] AS DOUBLE) - CAST(embedding[i + 12] AS DOUBLE)) ^ 2)) / 52, 6) AS mse FROM embeddings""",
)
def row_mse(spark, sf_dir):
    part = [F.slice("embedding", start, 52).cast("array<double>") for start in (1, 13)]
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _r(fn.row_mse(*part), "mse"))


@check("score_rows", f"WITH {SCORED} SELECT id, round(e, 6) AS reconstruction_error FROM scored")
def score_rows(spark, sf_dir):
    weights = formula_weights().to_table(spark, "fixed")
    loaded = ae.Weights.from_table(weights, "fixed")
    rows = prepare.features(vectors(spark, sf_dir))
    return ae.score(rows, loaded, Scaler.fit(vectors(spark, sf_dir))).select("id", _r("reconstruction_error"))


@check(
    "evaluate_scores",
    f"WITH {SCORED}, {VECTORS} SELECT id, ts, machine_status, sensor_00, round(e, 6) AS reconstruction_errors FROM vectors JOIN scored USING (id)",
)
def evaluate_scores(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    path = scratch_path(spark, "evaluated")
    writers.write_scored(offline.evaluate(rows, formula_weights(), Scaler.fit(rows)), path)
    return spark.read.parquet(path).select("id", "ts", "machine_status", "sensor_00", _r("reconstruction_errors"))


_SHAPES = ", ".join(f"({n}, {(a + 1) * b})" for n, (a, b) in enumerate(zip(ae.WIDTHS, ae.WIDTHS[1:])))


@check(
    "train_autoencoder",
    f"""SELECT CAST(layer AS INTEGER) AS layer, CAST(n AS BIGINT) AS weights, true AS finite, true AS loss_fell FROM (VALUES {_SHAPES}) t(layer, n)
        WHERE (SELECT count(*) FROM embeddings) > 0""",
)
def train(spark, sf_dir):
    rows = exclude_before_failure(vectors(spark, sf_dir), "ts", machine="machine_id", hours=1 / 3600)
    model = train_autoencoder(rows)
    path = scratch_path(spark, "weights")
    writers.write_weights(model.weights.to_table(spark, "0.0.1"), path)
    finite = F.min(~F.isnan("value") & (F.abs("value") < float("inf")))
    table = readers.read_weights(spark, path).groupBy("layer").agg(F.count("*").alias("weights"), finite.alias("finite"))
    return table.withColumn("loss_fell", F.lit(model.losses[-1] < model.losses[0] and stop_epoch(model.losses[:-1]) is None))


def _sql_step() -> str:
    """One Adam step on all rows in long form: (id, column, value) per layer."""
    weight = lambda n, r, c: f"(((({r}) * 7 + ({c}) * 13 + {n * 5}) % 11) - 5) / 20.0::DOUBLE"
    last = len(ae.WIDTHS) - 1
    parts = ["a0 AS (SELECT id, i - 1 AS r, x[i] AS v FROM x, range(1, 53) t(i))"]
    for n in range(last):
        total = f"sum(v * ({weight(n, 'r', 'c')})) + {weight(n, str(ae.WIDTHS[n]), 'c')}"
        value = f"greatest(0.0, {total})" if n < last - 1 else total
        parts.append(f"a{n + 1} AS (SELECT id, c AS r, {value} AS v FROM a{n}, range(0, {ae.WIDTHS[n + 1]}) t(c) GROUP BY id, c)")
    parts.append(f"u{last} AS (SELECT o.id, o.r AS c, 2 * (o.v - i.v) / (52.0 * (SELECT count(*) FROM embeddings)) AS u FROM a{last} o JOIN a0 i ON o.id = i.id AND o.r = i.r)")
    for n in range(last - 1, -1, -1):
        parts.append(
            f"g{n} AS (SELECT a.r, u.c, sum(a.v * u.u) AS g FROM a{n} a JOIN u{n + 1} u USING (id) GROUP BY a.r, u.c"
            f" UNION ALL SELECT {ae.WIDTHS[n]}, c, sum(u) FROM u{n + 1} GROUP BY c)"
        )
        if n:
            parts.append(
                f"u{n} AS (SELECT u.id, a.r AS c, sum(u.u * ({weight(n, 'a.r', 'u.c')})) * max(CASE WHEN a.v > 0 THEN 1.0 ELSE 0.0 END) AS u"
                f" FROM u{n + 1} u JOIN a{n} a USING (id) GROUP BY u.id, a.r)"
            )
    moved = lambda n: f"{weight(n, 'r', 'c')} - 0.001 * g / (abs(g) + 1e-8)"
    rows = " UNION ALL ".join(
        f'SELECT CAST({n} AS INTEGER) AS layer, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round({moved(n)}, 6) AS value FROM g{n}' for n in range(last)
    )
    return f"WITH {SCORED.split('h1 AS')[0].rstrip().rstrip(',')}, {', '.join(parts)} {rows}"


@check("train_step", _sql_step())
def train_step(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    stepped, _ = full_batch_step(rows, formula_weights(), Scaler.fit(rows))
    return stepped.to_table(spark, "1").select("layer", "row", "col", _r("value"))


_SLICES, _SEED = 4, 42


def _sql_epoch() -> str:
    """All mini-batches of one epoch in long form; a layer's input has a last row of ones for the bias."""
    last = len(ae.WIDTHS) - 1
    start = " UNION ALL ".join(
        f"SELECT {n} AS layer, r, c, (((r * 7 + c * 13 + {n * 5}) % 11) - 5) / 20.0::DOUBLE AS w"
        f" FROM range(0, {ae.WIDTHS[n] + 1}) t(r), range(0, {ae.WIDTHS[n + 1]}) s(c)"
        for n in range(last)
    )
    step = ["s AS (SELECT * FROM state)", "b AS (SELECT dealt.* FROM dealt JOIN (SELECT DISTINCT slice, step FROM s) n ON dealt.slice = n.slice AND dealt.k = n.step + 1)"]
    step.append("size AS (SELECT slice, count(*) AS size FROM b GROUP BY slice)")
    step.append("a0 AS (SELECT slice, id, i - 1 AS r, x[i] AS v FROM b, range(1, 53) t(i))")
    for n in range(last):
        total = f"sum(i{n}.v * s.w)"
        value = f"greatest(0.0, {total})" if n < last - 1 else total
        step.append(f"i{n} AS (SELECT * FROM a{n} UNION ALL SELECT slice, id, {ae.WIDTHS[n]}, 1.0 FROM b)")
        step.append(f"a{n + 1} AS (SELECT slice, id, c AS r, {value} AS v FROM i{n} JOIN s USING (slice, r) WHERE layer = {n} GROUP BY slice, id, c)")
    step.append(f"e AS (SELECT o.slice, o.id, o.r AS c, o.v - i.v AS d, 52.0 * size AS cells FROM a{last} o JOIN a0 i USING (slice, id, r) JOIN size USING (slice))")
    step.append(f"u{last} AS (SELECT slice, id, c, 2 * d / cells AS u FROM e)")
    for n in range(last - 1, -1, -1):
        step.append(f"g{n} AS (SELECT {n} AS layer, slice, r, c, sum(v * u) AS g FROM i{n} JOIN u{n + 1} USING (slice, id) GROUP BY slice, r, c)")
        if n:
            step.append(
                f"u{n} AS (SELECT slice, u.id, s.r AS c, sum(u.u * s.w) * max(CASE WHEN a.v > 0 THEN 1.0 ELSE 0.0 END) AS u FROM u{n + 1} u"
                f" JOIN s USING (slice, c) JOIN a{n} a USING (slice, id, r) WHERE s.layer = {n} GROUP BY slice, u.id, s.r)"
            )
    grown = " UNION ALL ".join(f"SELECT * FROM g{n}" for n in range(last))
    step.append(f"h AS (SELECT s.slice, s.step + 1 AS step, s.layer, s.r, s.c, s.w, 0.9 * s.m + 0.1 * g AS m, 0.999 * s.v + 0.001 * g * g AS v FROM s JOIN ({grown}) USING (slice, layer, r, c))")
    moved = "w - 0.001 * sqrt(1 - pow(0.999, step)) / (1 - pow(0.9, step)) * m / (sqrt(v) + 1e-8 * sqrt(1 - pow(0.999, step)))"
    loss = "SELECT slice, s.step + 1, -1, 0, 0, s.w + loss, 0.0, 0.0 FROM s JOIN (SELECT slice, sum(d * d / cells) AS loss FROM e GROUP BY slice) USING (slice) WHERE layer = -1"
    dealt = (
        f"dealt AS (SELECT id, x, slice, (row_number() OVER (PARTITION BY slice ORDER BY md5('{_SEED}:0:' || id)) - 1) // 50 + 1 AS k"
        f" FROM (SELECT *, CAST('0x' || md5('{_SEED}:' || id)[1:8] AS BIGINT) % {_SLICES} AS slice FROM x))"
    )
    return f"""WITH RECURSIVE {SCORED.split('h1 AS')[0].rstrip().rstrip(',')}, {dealt},
      state(slice, step, layer, r, c, w, m, v) AS (
        SELECT slice, 0, layer, r, c, w, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT slice FROM dealt), ({start} UNION ALL SELECT -1, 0, 0, 0.0)
        UNION ALL (WITH {', '.join(step)} SELECT slice, step, layer, r, c, {moved} AS w, m, v FROM h UNION ALL {loss})),
      done AS (SELECT state.*, n FROM state JOIN (SELECT slice, max(k) AS step, count(*) AS n FROM dealt GROUP BY slice) USING (slice, step))
      SELECT CAST(layer AS INTEGER) AS layer, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
        round(CASE WHEN layer < 0 THEN sum(w) / sum(step) ELSE sum(w * n) / sum(n) END, 6) AS value FROM done GROUP BY layer, r, c"""


@check("train_epoch", _sql_epoch())
def train_epoch(spark, sf_dir):
    """One epoch from known weights, as training runs it; the loss is layer -1."""
    model = train_autoencoder(vectors(spark, sf_dir), epochs=1, partitions=_SLICES, seed=_SEED, start=formula_weights())
    loss = spark.range(1).select(
        F.lit(-1).alias("layer"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.round(F.lit(model.losses[0]), 6).alias("value")
    )
    return model.weights.to_table(spark, "1").select("layer", "row", "col", _r("value")).unionByName(loss)


@check(
    "early_stop_epoch",
    """WITH l AS (SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS loss,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS epoch FROM lineitem),
       b AS (SELECT *, min(loss) OVER (PARTITION BY l_orderkey ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l),
       f AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN epoch END) OVER (PARTITION BY l_orderkey ORDER BY epoch) AS fell FROM b)
       SELECT l_orderkey, CAST(min(CASE WHEN epoch - fell >= 2 THEN epoch END) AS INTEGER) AS stop_epoch FROM f GROUP BY l_orderkey""",
)
def early_stop_epoch(spark, sf_dir):
    """An order's prices, at most seven, play the losses of a run."""
    runs = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").cast("double").alias("loss")))).alias("runs")
    )
    return runs.select("l_orderkey", stop_epochs(F.col("runs.loss"), patience=2).alias("stop_epoch"))


@check("score_loaded", f"WITH {SCORED} SELECT id, round(e, 6) AS reconstruction_error FROM scored")
def score_loaded(spark, sf_dir):
    """The model is stored with two versions and loaded by its version."""
    path = scratch_path(spark, "model")
    scorer(spark, sf_dir).save(spark, path, "0.0.1")
    other = Scaler(tuple([0.0] * 52), tuple([1.0] * 52))
    serving.Scorer(ae.Weights.initial(ae.WIDTHS, 1), other).save(spark, path, "0.0.2")
    loaded = serving.Scorer.load(spark, path, "0.0.1")
    return loaded(vectors(spark, sf_dir)).select("id", _r("reconstruction_error"))


@check(
    "history_messages",
    f"""WITH {WIDE} SELECT CAST(7 AS INTEGER) AS machine_id, {', '.join(f'coalesce({s}, 0.0) AS {s}' for s in WIDE_SENSORS)}, machine_status FROM wide""",
)
def history_messages(spark, sf_dir):
    texts = readers.history_messages(spark, _history_csv(spark, sf_dir), 7, WIDE_SENSORS)
    fields = [f for f in msg.reading_schema().fields if f.name in ("machine_id", *WIDE_SENSORS)]
    schema = T.StructType([*fields, T.StructField("machine_status", T.StringType())])
    return msg.accepted(msg.decode_messages(texts, schema=schema)).drop("value")


# --- thresholds, anomalies, counters ------------------------------------------


@check(
    "threshold_lookup",
    f"""WITH {READINGS}, {SOME_THRESHOLDS} SELECT machine_id, id, reconstruction_error, threshold FROM readings LEFT JOIN thresholds USING (machine_id)""",
)
def threshold_lookup(spark, sf_dir):
    found = attach_threshold(readings(spark, sf_dir), some_thresholds(spark, sf_dir))
    return found.select("machine_id", "id", "reconstruction_error", "threshold")


@check(
    "threshold_missing",
    f"""WITH {READINGS}, {SOME_THRESHOLDS} SELECT machine_id, id, reconstruction_error FROM readings
        WHERE machine_id NOT IN (SELECT machine_id FROM thresholds)""",
)
def threshold_missing(spark, sf_dir):
    lost = without_threshold(readings(spark, sf_dir), some_thresholds(spark, sf_dir))
    return lost.select("machine_id", "id", "reconstruction_error")


HISTORY = """history AS (SELECT user_id AS machine_id, value AS threshold, ts AS effective_at, event_id AS id
  FROM events WHERE event_type = 'purchase'),
live AS (SELECT event_id AS id, ts, user_id AS machine_id, value AS reconstruction_error FROM events WHERE event_type <> 'purchase')"""


@check(
    "threshold_latest",
    f"""WITH {HISTORY} SELECT machine_id, arg_max(threshold, effective_at) AS threshold, max(effective_at) AS effective_at
        FROM history GROUP BY machine_id""",
)
def threshold_latest(spark, sf_dir):
    path = scratch_path(spark, "thresholds")
    writers.append_thresholds(threshold_history(spark, sf_dir), path)
    return latest_thresholds(spark.read.parquet(path), "id")


_ASOF_SQL = f"""WITH {HISTORY} SELECT l.id, l.ts, l.machine_id, l.reconstruction_error, h.threshold FROM live l
  ASOF LEFT JOIN history h ON l.machine_id = h.machine_id AND l.ts >= h.effective_at"""


def _asof(**chunking) -> Query:
    def run(spark, sf_dir):
        return attach_threshold_asof(live_readings(spark, sf_dir), threshold_history(spark, sf_dir), **chunking)

    return run


check("threshold_asof", _ASOF_SQL)(_asof())
check("threshold_asof_split", _ASOF_SQL)(_asof(**FORCE_SPLIT))


@check(
    "anomaly_flag",
    f"""WITH {READINGS}, {THRESHOLDS} SELECT machine_id, id, reconstruction_error > threshold AS anomaly
        FROM readings JOIN thresholds USING (machine_id)""",
)
def anomaly_flag(spark, sf_dir):
    return serving.flag_anomalies(readings(spark, sf_dir), thresholds(spark, sf_dir)).select("machine_id", "id", "anomaly")


@check(
    "severity_error",
    """SELECT event_id AS id, CASE WHEN value / 50 >= 1.2 THEN 'red' WHEN value / 50 >= 0.3 THEN 'orange' ELSE 'green' END AS severity
       FROM events""",
)
def severity_error(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), fn.severity_error(F.col("value") / 50).alias("severity"))


@check(
    "severity_counter",
    """SELECT event_id AS id, CASE WHEN event_id % 21 >= 15 THEN 'red' WHEN event_id % 21 >= 10 THEN 'orange'
         WHEN event_id % 21 >= 5 THEN 'yellow' ELSE 'green' END AS severity FROM events""",
)
def severity_counter(spark, sf_dir):
    counter = F.col("event_id") % 21
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), fn.severity_counter(counter).alias("severity"))


def _flagged_sql(machine: str = "r.machine_id") -> str:
    return f"""{READINGS}, {THRESHOLDS}, flagged AS (
      SELECT id, ts, m AS machine_id, reconstruction_error, anomaly, CASE WHEN anomaly THEN 1 ELSE -1 END AS step,
             row_number() OVER (PARTITION BY m ORDER BY ts, id) AS rn
      FROM (SELECT r.id, r.ts, {machine} AS m, r.reconstruction_error, r.reconstruction_error > t.threshold AS anomaly
            FROM readings r JOIN thresholds t ON r.machine_id = t.machine_id))"""


_COUNTER_BAND = "CASE WHEN c >= 15 THEN 'red' WHEN c >= 10 THEN 'orange' WHEN c >= 5 THEN 'yellow' ELSE 'green' END"


@check(
    "anomaly_counter",
    f"""WITH RECURSIVE {_flagged_sql()}, {_walk('flagged')}
        SELECT machine_id, id, ts, reconstruction_error, anomaly, CAST(c AS INTEGER) AS anomaly_counter, {_COUNTER_BAND} AS severity
        FROM flagged JOIN walk USING (machine_id, rn)""",
)
def anomaly_counter(spark, sf_dir):
    flagged = serving.flag_anomalies(readings(spark, sf_dir), thresholds(spark, sf_dir))
    chunks = plan_chunks(readings(spark, sf_dir), ["machine_id"], "ts", "id")
    counted = serving.count_anomalies(flagged.drop("machine_status", "threshold"), chunks=chunks)
    return counted.withColumn("severity", fn.severity_counter(F.col("anomaly_counter")))


@check(
    "anomaly_counter_chunked",
    f"""WITH RECURSIVE {_flagged_sql('CASE WHEN r.machine_id % 3 = 0 THEN 0 ELSE r.machine_id END')}, {_walk('flagged')}
        SELECT machine_id, id, anomaly, CAST(c AS INTEGER) AS anomaly_counter FROM flagged JOIN walk USING (machine_id, rn)""",
)
def anomaly_counter_chunked(spark, sf_dir):
    """One machine owns a third of the rows and is counted in pieces."""
    flagged = serving.flag_anomalies(readings(spark, sf_dir), thresholds(spark, sf_dir))
    merged = F.when(F.col("machine_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("machine_id"))
    rows = flagged.select(merged.alias("machine_id"), "id", "ts", "anomaly")
    return serving.count_anomalies(rows, **FORCE_SPLIT).drop("ts")


RESET_SQL = f"""{HISTORY}, timed AS (
  SELECT l.*, h.threshold FROM live l ASOF JOIN history h ON l.machine_id = h.machine_id AND l.ts >= h.effective_at),
timeline AS (
  SELECT machine_id, ts, id, reconstruction_error, threshold, 1 AS kind,
         CASE WHEN reconstruction_error > threshold THEN 1 ELSE -1 END AS step FROM timed
  UNION ALL SELECT machine_id, effective_at, id, NULL, threshold, 0, 0 FROM history),
ordered AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, kind, id) AS rn FROM timeline)"""


@check(
    "anomaly_counter_reset",
    f"""WITH RECURSIVE {RESET_SQL}, {_walk('ordered')}
        SELECT machine_id, id, ts, reconstruction_error, threshold, step = 1 AS anomaly, CAST(c AS INTEGER) AS anomaly_counter
        FROM ordered JOIN walk USING (machine_id, rn) WHERE kind = 1""",
)
def anomaly_counter_reset(spark, sf_dir):
    return serving.count_with_history(live_readings(spark, sf_dir), threshold_history(spark, sf_dir))


_BATCH_SQL = "SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events"


def _batches(**chunking) -> Query:
    def run(spark, sf_dir):
        rows = readings(spark, sf_dir).select("id", "ts")
        return assign_batches(rows, **chunking).select("id", "seq", "batch_id")

    return run


check("batch_assign", f"SELECT id, seq, CAST((seq - 1) // 20 AS BIGINT) AS batch_id FROM ({_BATCH_SQL})")(_batches())
check("batch_assign_split", f"SELECT id, seq, CAST((seq - 1) // 20 AS BIGINT) AS batch_id FROM ({_BATCH_SQL})")(
    _batches(**FORCE_SPLIT)
)


# Events a hundred thousand times as fast, in whole milliseconds, so that both limits and ties at the time limit occur.
_TIMED_SQL = """WITH RECURSIVE a AS (SELECT event_id AS id, epoch_us(ts) // 100000000 AS ms, row_number() OVER (ORDER BY epoch_us(ts) // 100000000, event_id) AS seq FROM events),
  n AS (SELECT seq, least(seq + 20, 1 + count(*) OVER (ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND 49 FOLLOWING)) AS next FROM a),
  s(seq) AS (SELECT min(seq) FROM a UNION ALL SELECT n.next FROM s JOIN n ON n.seq = s.seq WHERE n.next <= (SELECT max(seq) FROM a))
  SELECT id, a.seq, CAST(count(s.seq) OVER (ORDER BY a.seq) - 1 AS BIGINT) AS batch_id FROM a LEFT JOIN s ON a.seq = s.seq"""


def _timed_batches(**chunking) -> Query:
    def run(spark, sf_dir):
        fast = F.timestamp_millis(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 100000000"))
        rows = readings(spark, sf_dir).select("id", fast.alias("ts"))
        return assign_timed_batches(rows, **chunking).select("id", "seq", "batch_id")

    return run


check("batch_assign_timeout", _TIMED_SQL)(_timed_batches())
check("batch_assign_timeout_split", _TIMED_SQL)(_timed_batches(**FORCE_SPLIT))


@check(
    "batch_last_counter",
    f"""WITH RECURSIVE {_flagged_sql()}, {_walk('flagged')},
        b AS (SELECT machine_id, id, c, seq, (seq - 1) // 20 AS batch_id FROM (
                SELECT machine_id, id, c, row_number() OVER (ORDER BY ts, id) AS seq FROM flagged JOIN walk USING (machine_id, rn)))
        SELECT machine_id, id, CAST(batch_id AS BIGINT) AS batch_id, CAST(c AS INTEGER) AS anomaly_counter,
               CAST(arg_max(c, seq) OVER (PARTITION BY batch_id) AS INTEGER) AS stored_counter FROM b""",
)
def batch_last(spark, sf_dir):
    flagged = serving.flag_anomalies(readings(spark, sf_dir), thresholds(spark, sf_dir))
    raw = readings(spark, sf_dir)
    chunks, arrival = plan_chunks(raw, ["machine_id"], "ts", "id"), plan_chunks(raw, [], "ts", "id")
    counted = serving.count_anomalies(flagged.select("machine_id", "id", "ts", "anomaly"), chunks=chunks)
    stored = batch_last_counter(assign_batches(counted, chunks=arrival))
    return stored.select("machine_id", "id", "batch_id", "anomaly_counter", "stored_counter")


@check(
    "batch_response",
    f"""WITH RECURSIVE {_flagged_sql()}, {_walk('flagged')},
        b AS (SELECT reconstruction_error AS e, c, seq, (seq - 1) // 20 AS batch_id FROM (
                SELECT reconstruction_error, c, row_number() OVER (ORDER BY ts, id) AS seq FROM flagged JOIN walk USING (machine_id, rn)))
        SELECT CAST(batch_id AS BIGINT) AS batch_id, string_agg(CAST(CAST(round(e * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY seq) AS errors,
               CAST(arg_max(c, seq) AS INTEGER) AS anomaly_counter FROM b GROUP BY batch_id""",
)
def batch_response(spark, sf_dir):
    raw = readings(spark, sf_dir)
    chunks, arrival = plan_chunks(raw, ["machine_id"], "ts", "id"), plan_chunks(raw, [], "ts", "id")
    flagged = serving.flag_anomalies(raw, thresholds(spark, sf_dir))
    counted = serving.count_anomalies(flagged.drop("machine_status", "threshold"), chunks=chunks)
    answers = serving.batch_response(assign_batches(counted, chunks=arrival))
    return answers.select("batch_id", _millionths("reconstruction_errors").alias("errors"), "anomaly_counter")


def _millionths(errors: str) -> Column:
    """A list of errors as text of whole millionths, to compare all of it."""
    return F.array_join(F.transform(errors, lambda e: F.round(e * 1e6).cast("long").cast("string")), ",")


# --- monitoring table and panels ----------------------------------------------

MONITORED = f"""{SCORED}, {VECTORS}, {VECTOR_THRESHOLDS}, base AS (
  SELECT v.*, s.e, s.e > t.threshold AS anomaly, CASE WHEN s.e > t.threshold THEN 1 ELSE -1 END AS step,
         row_number() OVER (PARTITION BY machine_id ORDER BY v.ts, v.id) AS rn,
         row_number() OVER (ORDER BY v.ts, v.id) AS seq
  FROM vectors v JOIN scored s USING (id) JOIN vthr t USING (machine_id)), {_walk('base')},
monitoring AS (SELECT (1::BIGINT << 30) + b.seq AS id, make_timestamp(((epoch_us(b.ts) + 500000) // 1000000) * 1000000) AS created_at,
  b.machine_id, {', '.join('b.' + s for s in SENSORS)}, CAST(NULL AS DOUBLE) AS sensor_52, round(b.e, 6) AS reconstruction_error,
  b.anomaly, CAST(w.c AS INTEGER) AS anomaly_counter, '{ORIGIN_BATCH}' AS origin
  FROM base b JOIN walk w USING (machine_id, rn))"""


def _monitoring(spark, sf_dir) -> str:
    raw = vectors(spark, sf_dir)
    counted = serving.score_batch(raw, scorer(spark, sf_dir), vector_thresholds(spark, sf_dir))
    path = scratch_path(spark, "monitoring")
    arrival = plan_chunks(raw, [], "ts", "id")
    writers.append_monitoring(writers.monitoring_rows(counted, ORIGIN_BATCH, 1, ingested_at="ts", chunks=arrival), path, 1)
    return path


def _shown(rows: DataFrame) -> DataFrame:
    shown = rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return shown.withColumn("reconstruction_error", _r("reconstruction_error")) if "reconstruction_error" in rows.columns else shown


@check("monitoring_append", f"WITH RECURSIVE {MONITORED} SELECT * FROM monitoring")
def monitoring_append(spark, sf_dir):
    return _shown(readers.read_monitoring(spark, _monitoring(spark, sf_dir)))


@check(
    "monitoring_two_writers",
    f"""WITH RECURSIVE {MONITORED} SELECT id + (2::BIGINT << 30) AS id, * EXCLUDE (id) FROM monitoring
        UNION ALL SELECT id + (((1::BIGINT << 26) + 2) << 30), * EXCLUDE (id) REPLACE ('{ORIGIN_STREAM}' AS origin) FROM monitoring""",
)
def monitoring_two_writers(spark, sf_dir):
    """Both origins store an append of the same number, and each repeats it."""
    raw, path = vectors(spark, sf_dir), scratch_path(spark, "monitoring")
    counted = serving.score_batch(raw, scorer(spark, sf_dir), vector_thresholds(spark, sf_dir))
    arrival = plan_chunks(raw, [], "ts", "id")
    for origin in (ORIGIN_BATCH, ORIGIN_STREAM) * 2:
        writer = writers.writer_of(origin)
        rows = writers.monitoring_rows(counted, origin, 3, ingested_at="ts", writer=writer, chunks=arrival)
        writers.append_monitoring(rows, path, 3, writer=writer)
    return _shown(readers.read_monitoring(spark, path))


# Readings as requests of 20, of which every seventh is cut off.
_REQUESTED = f"""{SCORED}, {VECTORS}, {VECTOR_THRESHOLDS},
        q AS (SELECT *, n // 20 AS batch_id, n % 20 AS position FROM (
                SELECT v.id, machine_id, e, v.ts, row_number() OVER (ORDER BY ts, v.id) - 1 AS n FROM vectors v JOIN scored s USING (id))),
        base AS (SELECT q.*, e > threshold AS anomaly, CASE WHEN e > threshold THEN 1 ELSE -1 END AS step,
                        row_number() OVER (PARTITION BY machine_id ORDER BY n) AS rn
                 FROM q JOIN vthr USING (machine_id) WHERE batch_id % 7 <> 2), {_walk('base')}"""


def _served(spark, sf_dir) -> tuple[serving.Served, str]:
    requests = _requests(vectors(spark, sf_dir))
    cut = F.when(F.col("batch_id") % 7 == 2, F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    table = scratch_path(spark, "monitoring")
    limits = vector_thresholds(spark, sf_dir)
    return serving.serve_batch(requests.withColumn("value", cut), scorer(spark, sf_dir), limits, table, 1), table


@check(
    "batch_request",
    f"""WITH RECURSIVE {_REQUESTED},
        a AS (SELECT batch_id, string_agg(CAST(CAST(round(e * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY position) AS errors,
                     CAST(arg_max(c, position) AS INTEGER) AS anomaly_counter FROM base JOIN walk USING (machine_id, rn) GROUP BY batch_id)
        SELECT CAST(batch_id AS BIGINT) AS batch_id, any_value(errors) AS errors, any_value(anomaly_counter) AS anomaly_counter,
               CASE WHEN batch_id % 7 = 2 THEN 1::BIGINT ELSE 0 END AS malformed,
               count(*) FILTER (WHERE batch_id % 7 <> 2 AND machine_id NOT IN (SELECT machine_id FROM vthr)) AS no_threshold
        FROM q LEFT JOIN a USING (batch_id) GROUP BY batch_id""",
)
def batch_request(spark, sf_dir):
    """Decode, score, flag, count, store, answer, refuse."""
    served, _ = _served(spark, sf_dir)
    count = lambda reason: F.sum((F.col("reason") == reason).cast("long")).alias(reason)
    refused = served.rejects.groupBy("batch_id").agg(count(serving.MALFORMED), count(serving.NO_THRESHOLD))
    both = served.response.join(refused, "batch_id", "full")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (serving.MALFORMED, serving.NO_THRESHOLD)]
    return both.select("batch_id", _millionths("reconstruction_errors").alias("errors"), "anomaly_counter", *zero)


@check(
    "batch_request_stored",
    f"""WITH RECURSIVE {_REQUESTED}, t AS (SELECT batch_id, min(ts) AS sent FROM q GROUP BY batch_id)
        SELECT (1::BIGINT << 30) + row_number() OVER (ORDER BY n) AS id, make_timestamp(((epoch_us(sent) + 500000) // 1000000) * 1000000) AS created_at,
               machine_id, {', '.join('v.' + s for s in SENSORS)}, CAST(NULL AS DOUBLE) AS sensor_52, round(e, 6) AS reconstruction_error,
               anomaly, CAST(c AS INTEGER) AS anomaly_counter, '{ORIGIN_BATCH}' AS origin
        FROM base JOIN walk USING (machine_id, rn) JOIN t USING (batch_id) JOIN (SELECT id, {', '.join(SENSORS)} FROM vectors) v USING (id)""",
)
def batch_request_stored(spark, sf_dir):
    """The rows that the requests left in the monitoring table, all columns of them."""
    _, table = _served(spark, sf_dir)
    return _shown(readers.read_monitoring(spark, table))


def _requests(rows: DataFrame) -> DataFrame:
    batched = assign_batches(rows)
    times = batched.groupBy("batch_id").agg(F.min("ts").alias("ts"))
    return msg.encode_batches(batched).withColumnRenamed("body", "value").join(times, "batch_id")


@check(
    "panel_error",
    f"""WITH RECURSIVE {MONITORED} SELECT id, created_at, reconstruction_error,
        CASE WHEN reconstruction_error >= 1.2 THEN 'red' WHEN reconstruction_error >= 0.3 THEN 'orange' ELSE 'green' END AS severity
        FROM monitoring WHERE machine_id = 7""",
)
def panel_error(spark, sf_dir):
    table = readers.read_monitoring(spark, _monitoring(spark, sf_dir), 7)
    return _shown(panels.error_panel(spark, table, 7))


@check(
    "panel_counter",
    f"""WITH RECURSIVE {MONITORED} SELECT id, created_at, anomaly_counter,
        {_COUNTER_BAND.replace('c >=', 'anomaly_counter >=')} AS severity FROM monitoring WHERE machine_id = 7""",
)
def panel_counter(spark, sf_dir):
    table = readers.read_monitoring(spark, _monitoring(spark, sf_dir), 7)
    return _shown(panels.counter_panel(spark, table, 7))


def _band(band: str) -> Query:
    def run(spark, sf_dir):
        table = readers.read_monitoring(spark, _monitoring(spark, sf_dir), 7)
        return _shown(panels.band_panel(spark, table, 7, band))

    return run


for _number, (_name, _members) in enumerate(SENSOR_BANDS.items(), start=1):
    _columns = ", ".join(f"sensor_{i:02d}" for i in _members)
    check(
        f"panel_band_{_number}",
        f"WITH RECURSIVE {MONITORED} SELECT id, created_at, {_columns} FROM monitoring WHERE machine_id = 7",
    )(_band(_name))


@check(
    "panel_bands",
    f"WITH RECURSIVE {MONITORED} "
    + " UNION ALL ".join(
        f"SELECT id, created_at, CAST({i} AS INTEGER) AS sensor, '{band}' AS band, sensor_{i:02d} AS value FROM monitoring WHERE machine_id = 7"
        for band, members in SENSOR_BANDS.items()
        for i in members
    ),
)
def panel_bands(spark, sf_dir):
    return _shown(panels.band_series(readers.read_monitoring(spark, _monitoring(spark, sf_dir), 7), 7))


# --- streaming ----------------------------------------------------------------


def _drain(spark, job: MonitorJob, start, rows: DataFrame, schema: T.StructType, slices: int = 3, spoil: Column | None = None) -> DataFrame:
    """Publish the rows in time slices; the job is restarted for each and picks up where it stopped."""
    inbox = scratch_path(spark, "inbox")
    edge = rows.agg(F.max("id").alias("top")).first()["top"] + 1
    for part in range(slices):
        mine = rows.where(F.floor(F.col("id") * slices / F.lit(edge)) == part)
        texts = mine.select("id", F.to_json(F.struct("*")).alias("value"))
        writers.publish_files(texts.select((F.col("value") if spoil is None else spoil).alias("value")), inbox)
        decoded = msg.decode_messages(readers.stream_messages(spark, inbox), schema=schema)
        start(job, decoded).awaitTermination()
    return readers.read_monitoring(spark, job.table)


def _job(spark) -> MonitorJob:
    base = scratch_path(spark, "stream")
    return MonitorJob(f"{base}/table", f"{base}/state", f"{base}/rejected", f"{base}/checkpoint")


@check(
    "stream_monitor",
    f"""WITH RECURSIVE {MONITORED} SELECT * EXCLUDE (id) REPLACE ('{ORIGIN_STREAM}' AS origin) FROM monitoring""",
)
def stream_monitor(spark, sf_dir):
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), *msg.reading_schema().fields]
    )
    model, limits = scorer(spark, sf_dir), vector_thresholds(spark, sf_dir)
    rows = vectors(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    table = _drain(spark, _job(spark), lambda j, d: j.start(d, model, limits, availableNow=True), rows, schema)
    return _shown(table.drop("id"))


@check(
    "stream_threshold_update",
    f"""WITH RECURSIVE {RESET_SQL}, {_walk('ordered')}
        SELECT make_timestamp(((epoch_us(ts) + 500000) // 1000000) * 1000000) AS created_at, CAST(machine_id AS INTEGER) AS machine_id,
               round(reconstruction_error, 6) AS reconstruction_error, step = 1 AS anomaly, CAST(c AS INTEGER) AS anomaly_counter
        FROM ordered JOIN walk USING (machine_id, rn) WHERE kind = 1""",
)
def stream_threshold_update(spark, sf_dir):
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("machine_id", T.IntegerType()),
            T.StructField("error", T.DoubleType()),
            T.StructField("threshold", T.DoubleType()),
            T.StructField("kind", T.StringType()),
        ]
    )
    control = F.col("event_type") == "purchase"
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("machine_id"),
        F.when(~control, F.col("value")).alias("error"),
        F.when(control, F.col("value")).alias("threshold"),
        F.when(control, "threshold").otherwise("reading").alias("kind"),
    )

    def start(job: MonitorJob, decoded: DataFrame):
        events = decoded.select(
            "value",
            "malformed",
            "id",
            "ts",
            "machine_id",
            F.when(F.col("kind") == "reading", F.col("error")).alias("reconstruction_error"),
            F.when(F.col("kind") == "threshold", F.col("threshold")).alias("set_threshold"),
        )
        return job.start_with_control(events, None, availableNow=True)

    table = _drain(spark, _job(spark), start, rows, schema)
    return _shown(table.select("created_at", "machine_id", "reconstruction_error", "anomaly", "anomaly_counter"))


@check(
    "stream_rejects",
    f"""WITH {READINGS}, {SOME_THRESHOLDS}, m AS (SELECT r.*, t.threshold FROM readings r LEFT JOIN thresholds t USING (machine_id))
        SELECT CASE WHEN id % 10 <> 3 THEN CAST(machine_id AS INTEGER) END AS machine_id,
               CASE WHEN id % 10 = 3 THEN 'malformed' WHEN id % 9 = 4 THEN 'no_score' WHEN threshold IS NULL THEN 'no_threshold' ELSE 'stored' END AS reason
        FROM m""",
)
def stream_rejects(spark, sf_dir):
    """Every message of a stream is stored or refused with a reason."""
    rows = readings(spark, sf_dir).select(
        "id", F.col("ts").cast("timestamp").alias("ts"), "machine_id", F.when(F.col("id") % 9 != 4, F.col("reconstruction_error")).alias("score")
    )
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("machine_id", T.IntegerType()),
                           T.StructField("score", T.StringType())])
    spoil = F.when(F.col("id") % 10 == 3, F.expr("substr(value, 1, length(value) - 2)")).otherwise(F.col("value"))
    limits = some_thresholds(spark, sf_dir)

    def start(job: MonitorJob, decoded: DataFrame):
        return job.start(decoded.withColumn("reconstruction_error", F.col("score").cast("double")).drop("score"), None, limits, availableNow=True)

    job = _job(spark)
    table = _drain(spark, job, start, rows, schema, spoil=spoil)
    refused = spark.read.parquet(job.rejected).select(F.when(F.col("reason") != "malformed", F.col("machine_id")).alias("machine_id"), "reason")
    return table.select("machine_id", F.lit("stored").alias("reason")).unionByName(refused)
