import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugewell.operators import failures, prepare, selection
from gaugewell.operators.batching import assign_batches, assign_timed_batches, batch_last_counter
from gaugewell.operators.counter import bounded_counter
from gaugewell.operators.ordering import CHUNK, carry_value, plan_chunks, row_sequence
from gaugewell.operators.scaler import Scaler, scale_by, scaler_statistics
from gaugewell.operators.thresholds import attach_threshold_asof, latest_thresholds
from gaugewell.plans.serving import NO_SCORE, NO_THRESHOLD, count_with_history, judge_with_history

T0 = dt.datetime(2024, 1, 1)
SPLIT = {"min_rows": 20, "pieces": 16}


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def history(spark, seed=1, rows=600):
    """One machine owns most rows: an outlier long ago, a burst in one second, and ties."""
    rng = random.Random(seed)
    out = [(1, 0, dt.datetime(1990, 5, 1), 1)]
    for i in range(1, rows):
        machine = 1 if rng.random() < 0.7 else rng.randint(2, 9)
        kind = rng.random()
        if kind < 0.3:
            ts = T0
        elif kind < 0.6:
            ts = T0 + dt.timedelta(microseconds=rng.randint(0, 900_000))
        else:
            ts = T0 + dt.timedelta(seconds=rng.randint(0, 500_000))
        out.append((machine, i, ts, rng.choice([1, 1, -1, -1, 0] if rng.random() < 0.1 else [1, -1])))
    rng.shuffle(out)
    return out, spark.createDataFrame(out, "machine_id long, id long, ts timestamp, step int")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def test_chunks_follow_the_order_and_bound_the_share(spark):
    raw, rows = history(spark)
    plan = plan_chunks(rows, ["machine_id"], "ts", "id", **SPLIT)
    assert plan.bins is not None
    got = [tuple(r) for r in plan.assign(rows).select("machine_id", "id", "ts", CHUNK).collect()]
    assert len(got) == len(raw)
    ordered = in_order(got)
    per_chunk = {}
    for a, b in zip(ordered, ordered[1:]):
        assert a[0] != b[0] or a[3] <= b[3]
    for r in got:
        per_chunk[r[0], r[3]] = per_chunk.get((r[0], r[3]), 0) + 1
    assert max(per_chunk.values()) <= 3 * 38  # share = ceil(600 / 16) = 38
    assert len([k for k in per_chunk if k[0] == 1]) > 5


def test_no_chunks_without_a_large_key(spark):
    _, rows = history(spark)
    plan = plan_chunks(rows, ["machine_id"], "ts", "id")
    assert plan.bins is None
    empty = rows.limit(0)
    assert plan_chunks(empty, [], "ts", "id").bins is None


@pytest.mark.parametrize("chunking", [{}, SPLIT])
def test_row_sequence(spark, chunking):
    raw, rows = history(spark, 2)
    got = {r["id"]: r["seq"] for r in row_sequence(rows, [], "ts", "id", **chunking).collect()}
    assert [got[r[1]] for r in sorted(raw, key=lambda r: (r[2], r[1]))] == list(range(1, len(raw) + 1))
    by_machine = {r["id"]: r["seq"] for r in row_sequence(rows, ["machine_id"], "ts", "id", **chunking).collect()}
    count = {}
    for machine, i, _, _ in in_order(raw):
        count[machine] = count.get(machine, 0) + 1
        assert by_machine[i] == count[machine]


@pytest.mark.parametrize("chunking", [{}, SPLIT])
@pytest.mark.parametrize("forward", [True, False])
def test_carry_value(spark, chunking, forward):
    raw, rows = history(spark, 3)
    known = F.when(F.col("id") % 40 == 0, F.col("id"))
    out = carry_value(rows.withColumn("v", known), ["machine_id"], "ts", "id", "v", "w", forward, **chunking)
    got = {r["id"]: r["w"] for r in out.collect()}
    last = {}
    ordered = in_order(raw)
    for machine, i, _, _ in ordered if forward else reversed(ordered):
        if i % 40 == 0:
            last[machine] = i
        assert got[i] == last.get(machine)


@pytest.mark.parametrize("chunking", [{}, SPLIT])
@pytest.mark.parametrize("with_start", [False, True])
def test_counter_matches_a_sequential_walk(spark, chunking, with_start):
    raw, rows = history(spark, 4, 900)
    start = {1: 13, 3: 20, 77: 5} if with_start else {}
    frame = spark.createDataFrame(list(start.items()), "machine_id long, counter int") if start else None
    got = {r["id"]: r["anomaly_counter"] for r in bounded_counter(rows, start=frame, **chunking).collect()}
    assert len(got) == len(raw)
    x = dict(start)
    for machine, i, _, step in in_order(raw):
        now = x.get(machine, 0)
        x[machine] = 0 if step == 0 else min(20, max(0, now + step))
        assert got[i] == x[machine]


def test_counter_edges(spark):
    def counters(flags):
        rows = spark.createDataFrame([(1, i, at(i), 1 if f else -1) for i, f in enumerate(flags)], "machine_id long, id long, ts timestamp, step int")
        return [r["anomaly_counter"] for r in bounded_counter(rows).orderBy("id").collect()]

    assert counters([True] * 25 + [False]) == [*range(1, 21), *[20] * 5, 19]
    assert counters([False] * 3 + [True]) == [0, 0, 0, 1]


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(20,0)"])
@pytest.mark.parametrize("chunking", [{}, SPLIT])
def test_counter_for_any_key_type(spark, kind, chunking):
    """Split or not, with small Arrow batches, and NULL as one machine of its own."""
    raw, rows = history(spark, 8, 700)
    keyed = F.when(F.col("machine_id") != 3, F.col("machine_id")).cast(kind).alias("machine_id")
    start = spark.createDataFrame([(1, 13), (2, 20)], "machine_id long, counter int").select(F.col("machine_id").cast(kind), "counter")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = bounded_counter(rows.select(keyed, "id", "ts", "step"), start=start, **chunking).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["id"]: r["anomaly_counter"] for r in out}
    x = {1: 13, 2: 20}
    assert len(out) == len(raw)
    for machine, i, _, step in in_order(raw):
        x[machine] = 0 if step == 0 else min(20, max(0, x.get(machine, 0) + step))
        assert got[i] == x[machine]


def test_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, float(i)) for i in range(90)], "id long, machine_id int, x double")
    want = {k: median([float(i) for i in range(90) if (None if i % 3 == 0 else i % 3) == k]) for k in (None, 1, 2)}
    assert {r["machine_id"]: r["median"] for r in selection.exact_medians(rows, ["x"], ["machine_id"]).collect()} == want
    holes = rows.withColumn("x", F.when(F.col("id") > 8, F.col("x")))
    filled = {r["id"]: r["x"] for r in prepare.impute_by(holes, ["x"], ["machine_id"]).collect()}
    assert len(filled) == 90 and filled[0] == median([float(i) for i in range(9, 90, 3)])
    scaled = {r["id"]: r["x"] for r in scale_by(rows, ["x"], ["machine_id"]).collect()}
    assert scaled[0] == 0.0 and scaled[87] == 1.0
    for few in (100_000, 5):
        selection._RANKED, old = few, selection._RANKED
        try:
            tests = [r["machine_id"] for r in selection.stratified_split(rows, "machine_id", "id").where("is_test").collect()]
        finally:
            selection._RANKED = old
        assert sorted(tests, key=str) == [1] * 9 + [2] * 9 + [None] * 9


def test_saved_statistics_are_not_cut(spark):
    table = spark.createDataFrame([(i, 0.0, float(i)) for i in range(3)], "sensor_idx int, min double, max double")
    assert Scaler.from_table(table).high == (0.0, 1.0, 2.0)
    for wrong in (table.where("sensor_idx <> 1"), table.union(table), spark.range(10_001).selectExpr("CAST(id AS int) AS sensor_idx", "0D AS min", "1D AS max")):
        with pytest.raises(ValueError):
            Scaler.from_table(wrong)
    with pytest.raises(ValueError):
        prepare.Imputer.load(spark.range(10_001).selectExpr("CAST(id AS string) AS column", "0D AS median"))


def test_counter_restarts_with_a_new_threshold(spark):
    readings = [(i, at(i), 1, 5.0) for i in (1, 2, 3, 4, 6)] + [(9, at(0.5), 2, 5.0)]
    scored = spark.createDataFrame(readings, "id long, ts timestamp, machine_id long, reconstruction_error double")
    writes = spark.createDataFrame([(1, 1.0, at(0), 0), (1, 2.0, at(6), 7)], "machine_id long, threshold double, effective_at timestamp, id long")
    got = {r["id"]: (r["threshold"], r["anomaly_counter"]) for r in count_with_history(scored, writes).collect()}
    # machine 2 has no threshold and is left out; the write at hour 6 comes before the reading at hour 6
    assert got == {1: (1.0, 1), 2: (1.0, 2), 3: (1.0, 3), 4: (1.0, 4), 6: (2.0, 1)}


def test_thresholds(spark):
    writes = spark.createDataFrame(
        [(7, 0.5, at(0), 1), (7, 0.02, at(2), 2), (7, 0.03, at(2), 3), (8, 1.0, at(1), 4)],
        "machine_id long, threshold double, effective_at timestamp, id long",
    )
    assert {r[0]: r[1] for r in latest_thresholds(writes, "id").collect()} == {7: 0.03, 8: 1.0}
    readings = spark.createDataFrame([(1, at(1), 7), (2, at(2), 7), (3, at(-1), 7)], "id long, ts timestamp, machine_id long")
    got = {r["id"]: r["threshold"] for r in attach_threshold_asof(readings, writes).collect()}
    assert got == {1: 0.5, 2: 0.03, 3: None}


def test_batches(spark):
    rows = spark.createDataFrame([(1, at(1), 1, 3), (2, at(2), 2, 0), (3, at(3), 1, 4)], "id long, ts timestamp, machine_id int, anomaly_counter int")
    out = batch_last_counter(assign_batches(rows, size=2)).orderBy("id")
    assert [(r["batch_id"], r["stored_counter"]) for r in out.collect()] == [(0, 0), (0, 0), (1, 4)]


def status_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, timestamp timestamp, machine_status string")


@pytest.mark.parametrize("exclude", [failures.exclude_before_failure, failures.exclude_before_failure_ordered])
def test_exclusion_bounds(spark, exclude):
    second = 1 / 3600
    rows = status_rows(spark, [(1, at(9), "NORMAL"), (2, at(9 - second), "NORMAL"), (3, at(10), "NORMAL"), (4, at(10), "BROKEN"),
                               (5, at(10 + second), "NORMAL"), (6, at(10 + second), "RECOVERING")])
    assert sorted(r["id"] for r in exclude(rows).collect()) == [2, 5]


def test_exclusion_matches_brute_force(spark):
    rng = random.Random(5)
    raw = [(i, at(rng.randint(0, 4000) / 60), rng.choice(["NORMAL", "NORMAL", "BROKEN"] if rng.random() < 0.15 else ["NORMAL"])) for i in range(400)]
    broken = [t for _, t, s in raw if s == "BROKEN"]
    for hours in (1, 2.5):
        width = dt.timedelta(hours=hours)
        expected = [i for i, t, s in raw if s == "NORMAL" and not any(b - width <= t <= b for b in broken)]
        rows = status_rows(spark, raw)
        assert sorted(r["id"] for r in failures.exclude_before_failure(rows, hours=hours).collect()) == expected
        split = failures.exclude_before_failure_ordered(rows, hours=hours, **SPLIT)
        assert sorted(r["id"] for r in split.collect()) == expected


def test_breakdown_windows(spark):
    rows = status_rows(spark, [(1, at(12), "NORMAL"), (2, at(20), "BROKEN"), (3, at(22), "BROKEN"), (4, at(23), "NORMAL"),
                               (5, at(25), "NORMAL"), (6, at(11.99), "NORMAL"), (7, at(25.01), "NORMAL")])
    got = sorted((r["breakdown_nb"], r["id"]) for r in failures.breakdown_windows(rows).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (2, 5)]


def median(values):
    values = sorted(values)
    n = len(values)
    return None if not n else (values[(n - 1) // 2] + values[n // 2]) / 2


def test_medians(spark):
    nan = math.nan
    rows = spark.createDataFrame(
        [(1.0, None, nan, "a"), (2.0, None, None, None), (None, None, None, "b"), (4.0, None, nan, "c"), (10.0, None, 1.0, "d")],
        "x double, y double, z double, s string",
    )
    got = {r["column"]: r["median"] for r in selection.exact_medians(rows, ["x", "y", "z"]).collect()}
    assert got["x"] == 3.0 and got["y"] is None and math.isnan(got["z"])
    filled = prepare.clean(rows).collect()
    assert [r["x"] for r in filled] == [1, 2, 3, 4, 10] and [r["y"] for r in filled] == [0] * 5
    assert [r["s"] for r in filled] == ["a", "MISSING", "b", "c", "d"]
    assert math.isnan(filled[0]["z"])


def test_medians_of_awkward_distributions(spark):
    rng = random.Random(6)
    n = 30_001
    columns = {
        "ties": [float(rng.randint(0, 3)) for _ in range(n)],
        "wide": [rng.choice([1, -1]) * 10.0 ** rng.randint(-200, 200) for _ in range(n)],
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "two": [0.0 if i % 2 else 1e9 for i in range(n)],
    }
    rows = spark.createDataFrame([(i % 3, *v) for i, v in enumerate(zip(*columns.values()))], "g int, " + ", ".join(f"{c} double" for c in columns))
    got = {r["column"]: r["median"] for r in selection.exact_medians(rows, list(columns)).collect()}
    assert got == {c: median(v) for c, v in columns.items()}
    by = {(r["g"], r["column"]): r["median"] for r in selection.exact_medians(rows, list(columns), ["g"]).collect()}
    assert by == {(g, c): median(v[g::3]) for g in range(3) for c, v in columns.items()}


def test_medians_of_infinities_and_nan(spark):
    rng = random.Random(8)
    n, inf, nan = 6_001, math.inf, math.nan
    columns = {
        "mostly": [inf if rng.random() < 0.9 else rng.gauss(0, 1) for _ in range(n)],
        "below": [-inf if rng.random() < 0.9 else rng.gauss(0, 1) for _ in range(n)],
        "edge": [inf if i % 2 else float(i) for i in range(n)],
        "both": [rng.choice([inf, -inf, rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(n)],
        "unknown": [nan if rng.random() < 0.7 else rng.gauss(0, 1) for _ in range(n)],
        "some": [nan if rng.random() < 0.2 else rng.uniform(-1.7e308, 1.7e308) for _ in range(n)],
    }
    order = lambda v: (math.isnan(v), v)  # noqa: E731  NaN comes last

    def middle(values):
        v = sorted(values, key=order)
        a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
        return a if a == b or math.isnan(a) else a + (b - a) / 2

    rows = spark.createDataFrame([(i % 3, *v) for i, v in enumerate(zip(*columns.values()))], "g int, " + ", ".join(f"{c} double" for c in columns))
    for margin in (0.001, None):
        got = {r["column"]: r["median"] for r in selection._bracketed_medians(rows, list(columns), [], margin).collect()}
        assert {c: repr(v) for c, v in got.items()} == {c: repr(middle(v)) for c, v in columns.items()}
    by = {(r["g"], r["column"]): repr(r["median"]) for r in selection.exact_medians(rows, list(columns), ["g"]).collect()}
    assert by == {(g, c): repr(middle(v[g::3])) for g in range(3) for c, v in columns.items()}


def test_bins_keep_the_order_and_spread_the_values(spark):
    values = [-math.inf, *[i * 1e304 for i in range(-9000, 9001)], math.inf, math.nan]
    rows = spark.createDataFrame([(v, -9e307, 9e307) for v in values], "value double, first double, last double")
    bins = [r["bin"] for r in rows.select("value", selection._bin().alias("bin")).orderBy("value").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 4000 and len(set(bins[-3:])) == 3 and bins[0] < bins[1]


def test_missed_bracket_is_widened(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("cast(id as double) as x")
    real, calls = selection._bracketed_medians, []

    def narrow(rows, columns, by, margin):
        calls.append(margin)
        out = real(rows, columns, by, margin)
        return out.withColumn("median", F.lit(None).cast("double")) if len(calls) == 1 else out

    monkeypatch.setattr(selection, "_bracketed_medians", narrow)
    assert selection.exact_medians(rows, ["x"]).first()["median"] == 499.5 and len(calls) == 2
    assert real(rows, ["x"], [], None).first()["median"] == 499.5


def test_null_timestamp_fails_the_audit(spark):
    rows = spark.createDataFrame([(None, 1.0)], "timestamp timestamp, x double")
    with pytest.raises(ValueError, match="1 null"):
        prepare.clean(rows)


def test_features_and_states(spark):
    rows = spark.createDataFrame([(1.1, 2.2, "NORMAL"), (3.0, 4.0, "BROKEN"), (5.0, 6.0, "MISSING")], "b double, a double, machine_status string")
    assert [r["features"] for r in prepare.features(rows, ["a", "b"]).collect()] == [[2.2, 1.1], [4.0, 3.0], [6.0, 5.0]]
    assert [r["series"] for r in prepare.by_status(rows).collect()] == ["normal", "broken"]


def test_not_null_keeps_nan(spark):
    rows = spark.createDataFrame([(1.0, math.nan), (None, 1.0)], "a double, b double")
    assert selection.not_null(rows).count() == 1


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") % 10 < 8, "N").when(F.col("id") == 9, "once").otherwise("B").alias("y"))
    out = selection.stratified_split(rows, "y", "id")
    counts = {(r["y"], r["is_test"]): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    assert {y: counts.get((y, True), 0) for y in totals} == {y: math.floor(0.3 * n + 0.5) for y, n in totals.items()}
    first = {r["id"] for r in out.where("is_test").collect()}
    again = selection.stratified_split(rows.repartition(5), "y", "id")
    assert first == {r["id"] for r in again.where("is_test").collect()}


def test_scaler(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", math.nan, 7.0)], "g string, x double, y double")
    stats = scaler_statistics(rows, ["x", "y"])
    assert [tuple(r) for r in stats.orderBy("sensor_idx").collect()] == [(0, 1.0, 3.0), (1, 5.0, 7.0)]
    fitted = Scaler.fit(rows, ["x", "y"])
    assert fitted == Scaler.from_table(fitted.to_table(spark)) == Scaler.from_table(stats)
    by = scale_by(rows, ["x", "y"], ["g"]).orderBy("g", "x").collect()
    assert [(r["x"], r["y"]) for r in by[:2]] == [(0.0, 0.0), (1.0, 0.0)]
    # fixed values: two sensors of a real pump reading, the second one constant
    pump = Scaler((0.0, 0.0), (2.549016, 0.0))
    row = pump.transform(spark.createDataFrame([(2.465394, 0.0)], "x double, y double"), ["x", "y"], "serve").first()
    assert row["x"] == pytest.approx(0.9671944, abs=1e-6) and row["y"] == 0


def test_a_sensor_without_range_scales_to_zero_in_both_forms(spark):
    import numpy as np

    from gaugewell.operators.autoencoder import scale_rows

    rows = spark.createDataFrame([(5.0,), (None,)], "sensor_00 double")
    got = Scaler((None,), (None,)).transform(rows, ["sensor_00"], "train").collect()
    assert [r[0] for r in got] == [0.0, None]
    assert scale_rows(np.array([[5.0]]), np.array([np.nan]), np.array([np.nan]), "train").tolist() == [[0.0]]


def timed(rows, size, timeout_ms):
    """(id, batch) by going through the rows in order."""
    out, first, n, batch = [], None, 0, -1
    for ts, i in sorted(rows):
        if batch < 0 or n == size or ts >= first + dt.timedelta(milliseconds=timeout_ms):
            first, n, batch = ts, 0, batch + 1
        n += 1
        out.append((i, batch))
    return out


@pytest.mark.parametrize("size, timeout_ms", [(20, 50), (3, 50), (7, 100_000)])
def test_batches_close_by_count_or_time(spark, size, timeout_ms):
    rng = random.Random(size)
    rows, now = [], T0
    for i in range(700):
        # bursts, steady runs of 5 ms (ties at 50 ms) and pauses
        now += dt.timedelta(milliseconds=rng.choice([0, 0, 5, 5, 5, 1] if i % 200 < 150 else [10, 50, 51, 400]))
        rows.append((now, i))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, ts) for ts, i in rows], "id long, ts timestamp").repartition(3)
    for chunking in ({}, {"min_rows": 30, "pieces": 16}):
        got = assign_timed_batches(frame, size=size, timeout_ms=timeout_ms, **chunking).orderBy("seq").collect()
        assert [(r["id"], r["batch_id"]) for r in got] == timed(rows, size, timeout_ms)
        assert [r["seq"] for r in got] == list(range(1, 701))


def test_batches_without_times(spark):
    rows = [(i, None) for i in range(5)] + [(9, T0), (10, T0 + dt.timedelta(milliseconds=50))]
    frame = spark.createDataFrame(rows, "id long, ts timestamp")
    assert [r["batch_id"] for r in assign_timed_batches(frame, size=4).orderBy("seq").collect()] == [0, 0, 0, 0, 1, 2, 3]
    assert not assign_timed_batches(frame.limit(0)).collect()


def test_readings_with_one_key_are_judged_one_by_one(spark):
    """Of two readings with the same machine, time and id only the one without a score is refused."""
    rows = spark.createDataFrame([(1, 5, T0, 0.9), (1, 5, T0, None), (2, 6, T0, 0.1)], "machine_id int, id long, ts timestamp, reconstruction_error double")
    history = spark.createDataFrame([(1, 0.5, T0, 1)], "machine_id int, threshold double, effective_at timestamp, id long")
    counted, refused = judge_with_history(rows, history)
    assert [(r["machine_id"], r["anomaly_counter"]) for r in counted.where("NOT is_control").collect()] == [(1, 1)]
    assert sorted((r["machine_id"], r["reason"]) for r in refused.collect()) == [(1, NO_SCORE), (2, NO_THRESHOLD)]


def test_clean_counts_what_is_left_while_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, "a", True), (2, None, None, True)], "id int, x double, s string, b boolean")
    imputer = prepare.Imputer.fit(rows)
    stored = prepare.clean(rows, imputer, str(tmp_path / "clean"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, prepare.clean(rows, imputer).collect()))
    assert stored.dtypes == imputer.transform(rows).dtypes and stored.count() == 2
    assert prepare.clean(rows.limit(0), imputer, str(tmp_path / "none")).count() == 0
    open_ = rows.withColumn("b", F.when(F.col("id") == 1, F.col("b")))
    for path in (None, str(tmp_path / "open")):
        with pytest.raises(ValueError, match="1 null values are left after imputation: b"):
            prepare.clean(open_, imputer, path)
