import math

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import messages as msg
from gaugewell.functions import scalar as fn
from gaugewell.schema import SENSOR_BANDS, SENSORS, reading_schema


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_or_zero(spark):
    texts = ["", "abc", " 1.5 ", "1.5d", "1e999", "2.5", "-.5", "5.", "+1e2", "2.5\n", "0x1p3", "0x10", "1_0", "-inf", "-nan"]
    expected = [0, 0, 0, 0, 0, 2.5, -0.5, 5, 100, 0, 8, 0, 0, -math.inf, 0]
    assert column(spark, texts, "string", fn.parse_or_zero) == expected
    assert math.isnan(column(spark, ["NaN"], "string", fn.parse_or_zero)[0])


def test_round_to_second(spark):
    texts = ["2024-01-01 00:00:00.4", "2024-01-01 00:00:00.5", "2024-01-01 00:00:59.6"]
    out = column(spark, texts, "string", lambda c: fn.round_to_second(c.cast("timestamp")).cast("string"))
    assert out == ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:01:00"]


def test_anomaly_is_strict_and_never_nan(spark):
    errors = [1.0, 1.0000001, math.nan, math.inf]
    assert column(spark, errors, "double", lambda c: fn.anomaly_flag(c, F.lit(1.0))) == [False, True, False, True]
    assert column(spark, [1.0], "double", lambda c: fn.anomaly_flag(c, F.lit(math.nan))) == [False]


def test_severity_edges(spark):
    assert column(spark, [0.29, 0.3, 1.19, 1.2, math.nan], "double", fn.severity_error) == [
        "green", "orange", "orange", "red", "green",
    ]
    assert column(spark, [4, 5, 9, 10, 14, 15, 20], "int", fn.severity_counter) == [
        "green", "yellow", "yellow", "orange", "orange", "red", "red",
    ]


def scaled(spark, rule, x, low, high):
    return column(spark, [x], "double", lambda c: rule(c, F.lit(low), F.lit(high)))[0]


def test_scaling_rules(spark):
    for rule in (fn.scale_train, fn.scale_serve):
        assert [round(scaled(spark, rule, x, 1.0, 1.2), 9) for x in (1.0, 1.1, 1.2)] == [0, 0.5, 1]
        assert scaled(spark, rule, 4.0, 4.0, 4.0) == 0
    assert scaled(spark, fn.scale_serve, 3.0, 1.0, 1.0) == 2.0
    assert scaled(spark, fn.scale_train, 3.0, 1.0, 1.0) == fn.FLOAT32_MAX
    assert scaled(spark, fn.scale_train, -3.0, 1.0, 1.0) == -fn.FLOAT32_MAX
    assert scaled(spark, fn.scale_train, math.nan, 1.0, 2.0) == 0
    assert math.isnan(scaled(spark, fn.scale_serve, math.nan, 1.0, 2.0))
    assert scaled(spark, fn.scale_train, math.inf, 1.0, 2.0) == fn.FLOAT32_MAX


def test_row_mse(spark):
    rows = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 4.0]), ([1.0, 2.0, 3.0], [1.0, 2.0])],
        "a array<double>, b array<double>",
    )
    out = [r[0] for r in rows.select(fn.row_mse(F.col("a"), F.col("b"))).collect()]
    assert out[0] == 0 and out[1] == pytest.approx(1 / 3, abs=1e-6) and out[2] is None


def test_bands_cover_all_sensors():
    assert sorted(i for band in SENSOR_BANDS.values() for i in band) == list(range(len(SENSORS)))


SCHEMA = reading_schema(SENSORS[:2])


def test_decode_messages(spark):
    texts = [
        '{"machine_id": 123, "sensor_00": 1.5, "machine_status": "NORMAL"}',
        "{invalid json}",
        '{"machine_id": 1, "sensor_00": "x"}',
        '{"machine_id": 7.5}',
        "",
        "[]",
        '{"sensor_01": null}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    out = msg.decode_messages(rows, schema=SCHEMA).orderBy("id").collect()
    assert [r["malformed"] for r in out] == [False, True, True, True, True, True, False]
    assert tuple(out[0])[3:] == (123, 1.5, 0.0)
    assert tuple(out[6])[3:] == (0, 0.0, 0.0)


def test_decode_arrays(spark):
    texts = ['[{"machine_id": 123}, {"machine_id": 456, "sensor_01": 2}]', "{invalid json}", "[]", '{"machine_id": 1}',
             '[{"machine_id": 5}, {"machine_id": "x"}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "batch_id int, value string")
    out = msg.decode_arrays(rows, schema=SCHEMA)
    got = [tuple(r) for r in out.orderBy("batch_id", "position").select("batch_id", "position", "malformed", "machine_id", "sensor_01").collect()]
    assert got == [(0, 0, False, 123, 0.0), (0, 1, False, 456, 2.0), (1, 0, True, 0, 0.0), (3, 0, True, 0, 0.0),
                   (4, 0, False, 5, 0.0), (4, 1, True, 0, 0.0)]
    assert [r["machine_id"] for r in msg.strict_batches(out).orderBy("position").collect()] == [123, 456]


def test_encode(spark):
    rows = spark.createDataFrame([(0, 2, 7, 1.0, "NORMAL"), (0, 1, 7, 2.0, "BROKEN")],
                                 "batch_id int, seq int, machine_id int, sensor_00 double, machine_status string")
    one = rows.select(msg.encode_reading(["sensor_00"]).alias("v")).first()["v"]
    assert one == '{"machine_id":7,"sensor_00":1.0,"machine_status":"NORMAL"}'
    body = msg.encode_batches(rows, ["sensor_00"]).first()["body"]
    assert body == '[{"machine_id":7,"sensor_00":2.0},{"machine_id":7,"sensor_00":1.0}]'


def test_strict_messages(spark):
    good = ['{"machine_id": 7, "sensor_01": 1e3}', ' {"machine_id":7,"other":[1,{"a":"]"}]} ', "{}"]
    bad = [
        '{"machine_id":1}{"machine_id":2}', '{"machine_id":1} garbage', '{"machine_id":1},{"machine_id":2}', '{"machine_id":1}] [', '{"machine_id":1},0] x',
        '{"sensor_01": NaN}', '{"sensor_01": "NaN"}', '{"sensor_01": 1e999}', "{'machine_id': 1}", '{"machine_id": "x"}', "", "[]", "null", None,
    ]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "id long, value string")
    out = {r["id"]: r["malformed"] for r in msg.decode_messages(rows, schema=SCHEMA).collect()}
    assert [out[i] for i in range(len(good))] == [False] * len(good)
    assert [out[i] for i in range(len(good), len(out))] == [True] * len(bad)
    bodies = spark.createDataFrame([(1, '[{"machine_id":1},{"machine_id":2}]'), (2, '[{"machine_id":1}] tail'), (3, "[]")], "batch_id long, value string")
    got = sorted((r["batch_id"], r["machine_id"], r["malformed"]) for r in msg.decode_arrays(bodies, schema=SCHEMA).collect())
    assert got == [(1, 1, False), (1, 2, False), (2, 0, True)]


def test_a_filter_on_decoded_messages_does_not_parse_again(spark):
    texts = spark.range(40).select("id", F.concat(F.lit('{"machine_id":'), F.when(F.col("id") % 4 != 1, F.col("id").cast("string")).otherwise("x"), F.lit("}")).alias("value"))
    decoded = msg.decode_messages(texts, schema=SCHEMA)
    for kept, want in ((msg.accepted(decoded), [i for i in range(40) if i % 4 != 1]), (msg.rejects(decoded), list(range(1, 40, 4)))):
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
        assert sorted(r["id"] for r in kept.collect()) == want
