import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import autoencoder as ae
from gaugewell.operators import training
from gaugewell.operators.scaler import Scaler
from gaugewell.plans import offline, panels, serving
from gaugewell.schema import ORIGIN_STREAM, MONITORING_SCHEMA, SENSORS
from gaugewell.sources import readers, writers
from gaugewell.streaming import monitor

SMALL = [f"sensor_{i:02d}" for i in range(4)]


def ramp(spark, rows=300):
    """Four sensors that move together, one of them constant."""
    rng = np.random.default_rng(0)
    base = rng.uniform(0, 1, rows)
    data = [(i, float(b), float(2 * b + 1), float(5 - b), 3.0) for i, b in enumerate(base)]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{s} double" for s in SMALL))


def test_gradient_matches_differences():
    layers = [m.copy() for m in ae.Weights.initial((4, 3, 2, 3, 4), seed=1).layers]
    x = np.random.default_rng(2).uniform(0, 1, (7, 4))
    _, gradient = training.loss_and_gradient(layers, x)
    for n, layer in enumerate(layers):
        for at in [(0, 0), (1, 1), (layer.shape[0] - 1, 0)]:
            kept = layer[at]
            layer[at] = kept + 1e-6
            up = training.loss_and_gradient(layers, x)[0]
            layer[at] = kept - 1e-6
            down = training.loss_and_gradient(layers, x)[0]
            layer[at] = kept
            assert gradient[n][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_early_stopping():
    losses = [5.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0]
    assert [training.stop_epoch(losses[: i + 1]) for i in range(7)] == [None] * 6 + [7]
    assert training.stop_epoch([5.0, 4.0, 4.0, 4.0, 4.0, 4.0, 3.0]) is None


def test_training_lowers_the_loss_and_saves_versions(spark, tmp_path):
    rows = ramp(spark)
    model = training.train_autoencoder(rows, SMALL, epochs=6, partitions=2)
    assert len(model.losses) == 6 and model.losses[-1] < model.losses[0] and not model.stopped_early
    path = str(tmp_path / "weights")
    for version in ("1", "2", "2"):
        writers.write_weights(model.weights.to_table(spark, version), path)
    table = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    assert table.count() == 2 * sum(m.size for m in model.weights.layers)
    back = ae.Weights.from_table(table, "2")
    assert all(np.array_equal(a, b) for a, b in zip(back.layers, model.weights.layers))
    with pytest.raises(ValueError, match="no rows"):
        training.train_autoencoder(rows.limit(0).fillna(0.0), SMALL, epochs=1)


def test_training_does_not_depend_on_the_layout(spark):
    """Slices and orders come from the ids; batches of the transfer cut mini-batches."""
    rows = ramp(spark, 400)
    first = training.train_autoencoder(rows.coalesce(1), SMALL, epochs=2, partitions=3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = training.train_autoencoder(rows.repartition(5), SMALL, epochs=2, partitions=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert first.losses == pytest.approx(again.losses, abs=1e-12)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(first.weights.layers, again.weights.layers))


def test_training_on_one_partition_is_plain_adam(spark):
    rows = ramp(spark, 40)  # less than one mini-batch, so row order does not matter
    model = training.train_autoencoder(rows, SMALL, epochs=3, partitions=1)
    scaler = Scaler.fit(rows, SMALL)
    x = np.array([[r[s] for s in SMALL] for r in rows.collect()])
    low, high = np.array(scaler.low), np.array(scaler.high)
    x = np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0.0)
    layers = list(ae.Weights.initial((4, 24, 12, 24, 4), 42).layers)
    shapes = [m.shape for m in layers]
    w = np.concatenate([m.ravel() for m in layers])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 4):
        _, g = training.loss_and_gradient(training._unpack(w, shapes), x)
        g = np.concatenate([a.ravel() for a in g])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.001 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got = np.concatenate([a.ravel() for a in model.weights.layers])
    assert np.allclose(got, w, atol=1e-9)


def test_scores_and_rejects(spark):
    weights = ae.Weights.initial((4, 3, 4), seed=3)
    scaler = Scaler((0.0, 0.0, 0.0, 1.0), (2.0, 4.0, 1.0, 1.0))
    inputs = [[1.0, 2.0, 0.5, 1.0], [1.0, None, 0.5, 1.0], [1.0, 2.0], None, [0.0, 4.0, 1.0, 3.0]]
    rows = spark.createDataFrame(list(enumerate(inputs)), "id int, features array<double>").coalesce(1)

    def scored(**how):
        return [r["reconstruction_error"] for r in ae.score(rows, weights, scaler, **how).orderBy("id").collect()]

    def expected(x):
        hidden = np.maximum(np.array(x) @ weights.layers[0][:-1] + weights.layers[0][-1], 0)
        return float(np.mean((hidden @ weights.layers[1][:-1] + weights.layers[1][-1] - x) ** 2))

    serve = scored()
    assert serve[0] == pytest.approx(expected([0.5, 0.5, 0.5, 0.0]))
    assert serve[4] == pytest.approx(expected([0.0, 1.0, 1.0, 2.0]))
    assert serve[1:4] == [None] * 3 and scored(on_error="zero")[1:4] == [0.0] * 3
    assert scored(rule="train")[0] == pytest.approx(serve[0])
    empty = ae.score(rows.limit(0), weights, scaler)
    assert empty.count() == 0


def test_offline_run(spark, tmp_path):
    rows = ramp(spark, 240)
    status = F.when(F.col("id") == 120, "BROKEN").when(F.col("id").between(121, 130), "RECOVERING").otherwise("NORMAL")
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60), "yyyy-MM-dd HH:mm:ss")
    table = rows.select(
        F.col("id").alias("index"), time.alias("timestamp"), SMALL[0], F.when(F.col("id") % 5 > 0, F.col(SMALL[1])).alias(SMALL[1]),
        *SMALL[2:], status.alias("machine_status"),
    )
    table.write.option("header", True).csv(str(tmp_path / "history"))
    run = offline.run_offline(spark, str(tmp_path / "history"), str(tmp_path / "out"), epochs=2, partitions=2, sensors=SMALL)
    assert run.scored.count() == 240 and run.scored.where("reconstruction_errors IS NULL").isEmpty()
    cleaned = run.scored.drop("reconstruction_errors")
    # the hour before the breakdown and the other states are left out
    assert offline.training_rows(cleaned).count() == 240 - 11 - 60
    assert offline.training_rows(cleaned, exclude=False).count() == 240
    with_id = run.scored.withColumn("id", F.unix_micros("timestamp"))
    counts = {r["series"]: r["count"] for r in offline.breakdown_report(with_id).groupBy("series").count().collect()}
    assert counts == {"normal": 229, "broken": 1, "recovering": 10}
    assert offline.error_report(run.scored).where("is_broken").count() == 1


def test_malformed_history_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("i,timestamp," + ",".join(SMALL) + ",machine_status\n0,2020-01-01 00:00:00,1,x,1,1,NORMAL\n")
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        readers.read_history(spark, str(path), SMALL).collect()
    path.write_text("i,timestamp," + ",".join(SMALL) + ",machine_status\n0,yesterday,1,,1,1,NORMAL\n")
    with pytest.raises(Exception, match="(?i)parse|timestamp"):
        readers.read_history(spark, str(path), SMALL).collect()
    path.write_text(",timestamp," + ",".join(SMALL) + ",machine_status\n0,2020-01-01 00:00:00,1,,1,1,NORMAL\n")
    row = readers.read_history(spark, str(path), SMALL).first()
    assert row["sensor_01"] is None and row["sensor_00"] == 1.0 and "index" not in row


def test_malformed_lines_are_refused_with_a_reason(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    good = ["0,2020-01-01 00:00:00,1,,1,1,NORMAL", "1,2020-01-01 00:01:00.5,NaN,2,1,1,", '2,,1,2,3,4,"a, b"', ",2020-01-01 00:00:00,,,,,"]
    bad = {
        "3,2020-01-01 00:00:00,1,x,1,1,NORMAL": "number",
        "3.5,2020-01-01 00:00:00,1,1,1,1,NORMAL": "number",
        "4,yesterday,1,2,1,1,NORMAL": "time",
        "5,2020-02-30 00:00:00,1,2,1,1,NORMAL": "time",
        "6,yesterday,x,2,1,1,NORMAL,more": "cells",
        "7,2020-01-01 00:00:00,1": "cells",
        '8,2020-01-01 00:00:00,1,2,1,1,"a, b",more': "cells",
        '9,yesterday,x,2,1,1,"a, b"': "number",
    }
    header = "i,timestamp," + ",".join(SMALL) + ",machine_status"
    path.write_text("\n".join([header, *good, *bad]) + "\n")
    rows, refused = readers.read_history_or_refuse(spark, str(path), SMALL)
    assert {(r["line"].split(",")[0], r["reason"]) for r in refused.collect()} == {(k.split(",")[0], v) for k, v in bad.items()}
    assert {r["line"] for r in refused.where("reason <> 'time'").collect()} == {k for k, v in bad.items() if v != "time"}
    # the good lines come out as the strict reader gives them
    clean = tmp_path / "clean.csv"
    clean.write_text("\n".join([header, *good]) + "\n")
    strict = readers.read_history(spark, str(clean), SMALL)
    assert rows.schema == strict.schema
    assert sorted(map(str, rows.collect())) == sorted(map(str, strict.collect()))
    # a result has its rows whichever columns are read of it
    assert rows.select("sensor_02").count() == len(good) and refused.count() == len(bad)
    for text in ("", header + "\n"):
        path.write_text(text)
        rows, refused = readers.read_history_or_refuse(spark, str(path), SMALL)
        assert rows.isEmpty() and refused.isEmpty()


def test_offline_run_keeps_refused_lines(spark, tmp_path):
    header = "i,timestamp," + ",".join(SMALL) + ",machine_status"
    lines = [f"{i},2020-01-01 {i // 60:02}:{i % 60:02}:00,{i % 7},{i % 5},{i % 3},{i % 2},NORMAL" for i in range(240)]
    lines[17], lines[99] = "17,at noon,1,1,1,1,NORMAL", "99,2020-01-01 00:00:00,one,1,1,1,NORMAL"
    path = tmp_path / "history.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    run = offline.run_offline(spark, str(path), str(tmp_path / "out"), epochs=1, partitions=2, sensors=SMALL, refuse=True)
    assert run.scored.count() == 238
    refused = spark.read.parquet(str(tmp_path / "out" / "refused")).collect()
    assert sorted((r["reason"], r["line"].split(",")[0]) for r in refused) == [("number", "99"), ("time", "17")]


def test_scaler_files(spark, tmp_path):
    table = Scaler((0.0, -1.0, 2.0), (1.0, 1.0, 4.0)).to_table(spark)
    writers.write_scaler(table, str(tmp_path / "p"))
    writers.write_scaler_csv(table, str(tmp_path / "c"))
    assert Scaler.from_table(readers.read_scaler(spark, str(tmp_path / "p"))).low == (0.0, -1.0, 2.0)
    assert Scaler.from_table(readers.read_scaler_csv(spark, str(tmp_path / "c"))).high == (1.0, 1.0, 4.0)


def counted_rows(spark):
    rows = spark.range(1, 41).select(
        "id", F.timestamp_millis(F.col("id") * 600).alias("ts"), (F.col("id") % 20).cast("int").alias("machine_id"),
        (F.col("id") / 10).alias("reconstruction_error"), *[(F.col("id") + i).cast("double").alias(s) for i, s in enumerate(SENSORS)],
    )
    limits = spark.range(20).select(F.col("id").cast("int").alias("machine_id"), F.lit(2.0).alias("threshold"))
    return serving.count_anomalies(serving.flag_anomalies(rows, limits.where("machine_id <> 3")))


def test_monitoring_table(spark, tmp_path):
    path = str(tmp_path / "monitoring")
    rows = writers.monitoring_rows(counted_rows(spark), "api", 2, ingested_at="ts")
    assert rows.schema.names == MONITORING_SCHEMA.names
    for _ in range(2):  # repeating an append changes nothing
        writers.append_monitoring(rows, path, 2)
    writers.append_monitoring(rows.limit(0), path, 3)
    table = readers.read_monitoring(spark, path)
    assert table.count() == 38 and table.agg(F.countDistinct("id")).first()[0] == 38
    assert table.where("sensor_52 IS NOT NULL").isEmpty()
    # another writer with the same number has its own folder and ids
    other = writers.monitoring_rows(counted_rows(spark), ORIGIN_STREAM, 2, ingested_at="ts")
    writers.append_monitoring(other, str(tmp_path / "both"), 2, writer=1)
    writers.append_monitoring(rows, str(tmp_path / "both"), 2)
    assert readers.read_monitoring(spark, str(tmp_path / "both")).agg(F.countDistinct("id")).first()[0] == 76
    with pytest.raises(ValueError):
        writers.monitoring_rows(counted_rows(spark), "api", 1 << 26)
    one = readers.read_monitoring(spark, path, 7)
    got = [(r["created_at"].second, r["reconstruction_error"], r["severity"]) for r in panels.error_panel(spark, one, 7).collect()]
    assert got == [(4, 0.7, "orange"), (16, 2.7, "red")]
    assert [r["anomaly_counter"] for r in panels.counter_panel(spark, one, 7).collect()] == [0, 1]
    assert panels.band_series(one, 7).count() == 2 * 52
    assert len(panels.band_panel(spark, one, 7, "42-71").columns) == 2 + 13
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "machine_bucket" in filters and "buckets" in filters
    # appends with other numbers of buckets are found as well, and only their own folders are read
    for n, buckets in enumerate((1, 64), start=4):
        writers.append_monitoring(rows, path, n, buckets=buckets)
    one = readers.read_monitoring(spark, path, 7)
    assert one.count() == 3 * 2 and readers.read_monitoring(spark, path, -1).count() == 0
    files = {f for f in one.select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert {f.split("buckets=")[1].split("/part")[0] for f in files} == {"16/machine_bucket=7", "1/machine_bucket=0", "64/machine_bucket=7"}


STATE_ROWS = "machine_id int, threshold double, counter int"


def test_state_after_many_batches_and_repeats(spark, tmp_path):
    states = monitor.MachineState(str(tmp_path / "state"), period=3)
    known = {}
    machines = spark.range(7).select(F.col("id").cast("int").alias("machine_id"))
    for batch in range(11):
        changed = {(batch * k) % 7: (float(batch), batch + k) for k in (1, 2)}
        for _ in range(2):  # the second time it is a repeat after a failure
            found = {r["machine_id"]: (r["threshold"], r["counter"]) for r in states.before(spark, batch, machines).collect()}
            assert found == known
            states.write(spark.createDataFrame([(m, *v) for m, v in changed.items()], STATE_ROWS), batch)
        known |= changed


def test_state_writes_touched_machines_only(spark, tmp_path):
    path = str(tmp_path / "state")
    states = monitor.MachineState(path, period=2)
    everyone = spark.range(100_000).select(F.col("id").cast("int").alias("machine_id"), F.lit(0.5).alias("threshold"), F.lit(3).alias("counter"))
    states.write(everyone, 0)
    states.write(everyone.limit(0), 1)
    touched = everyone.where("machine_id % 10000 = 0").select("machine_id")
    before = states.before(spark, 2, touched.union(spark.createDataFrame([(None,), (-5,)], "machine_id int")))
    assert before.count() == 10
    counted = touched.select(
        "machine_id", F.lit(0.5).alias("threshold"), F.lit(4).alias("anomaly_counter"), F.lit(1).alias("ts"), F.lit(1).alias("id")
    )
    states.write(monitor._changes(before, counted, "ts", "id"), 2)
    assert spark.read.parquet(f"{path}/slot=0").count() == 10
    assert states.before(spark, 3, everyone.select("machine_id")).groupBy("counter").count().orderBy("counter").collect() == [(3, 99_990), (4, 10)]


def test_a_micro_batch_that_loses_messages_is_an_error(spark):
    batch = spark.range(5)
    monitor._check_complete(batch, 5, 7)
    with pytest.raises(RuntimeError, match="micro-batch 7: 5 messages, 4"):
        monitor._check_complete(batch, 4, 7)


def test_no_threshold_moves_no_counter(spark):
    got = counted_rows(spark)
    assert got.where("machine_id = 3").isEmpty()
    assert math.isclose(got.where("anomaly").count(), 19)
