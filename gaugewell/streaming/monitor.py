"""Stream scoring into the monitoring table.

Decoding and scoring run in the streaming plan itself. The counter needs the
rows of a machine in order and one machine may send a large share of them, so
each micro-batch is counted with the batch operator, which can split such a
machine, instead of a state function that gets all rows of a key in one task.
Counters and thresholds are kept as changes: a micro-batch reads the state of
the machines in it and writes theirs, and its monitoring rows go to their own
folder. Repeating a micro-batch after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gaugewell.functions.messages import accepted
from gaugewell.operators.ordering import plan_chunks
from gaugewell.plans.serving import MALFORMED, Scorer, count_anomalies, judge, judge_with_history
from gaugewell.schema import ORIGIN_STREAM
from gaugewell.sources.writers import append_monitoring, monitoring_rows, writer_of

STATE = "machine_id int, threshold double, counter int"


@dataclass(frozen=True)
class MachineState:
    """Counter and threshold of every machine: a base, and the changes of the micro-batches since.

    Micro-batch n writes the machines it touched into slot n % ``period``. The last one of a period
    also folds the period's changes into the other one of two bases, which the next period reads, so
    the whole state is rewritten once in ``period`` triggers. A micro-batch reads no folder that it
    writes, and may be repeated until the next one begins.
    """

    path: str
    period: int = 32

    def _newest(self, spark: SparkSession, period: int, slots: int, machines: DataFrame | None = None) -> DataFrame:
        """The state after a number of slots of a period."""
        folders = [f"{self.path}/base={period % 2}"] if period else []
        folders += [f"{self.path}/slot={slot}" for slot in range(slots)]
        schema = f"{STATE}, batch long"
        rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
        if machines is not None:
            rows = rows.join(machines, "machine_id", "left_semi")
        newest = F.max_by(F.struct("threshold", "counter", "batch"), "batch").alias("now")
        return rows.groupBy("machine_id").agg(newest).select("machine_id", "now.*")

    def before(self, spark: SparkSession, batch_id: int, machines: DataFrame) -> DataFrame:
        """The state before a micro-batch of those machines that are known."""
        return self._newest(spark, *divmod(batch_id, self.period), machines).drop("batch")

    def write(self, changed: DataFrame, batch_id: int) -> None:
        rows = changed.select("machine_id", "threshold", "counter", F.lit(batch_id).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/slot={batch_id % self.period}")
        number, slot = divmod(batch_id, self.period)
        if slot == self.period - 1:
            folded = self._newest(changed.sparkSession, number, self.period)
            folded.write.mode("overwrite").parquet(f"{self.path}/base={(number + 1) % 2}")


def _changes(before: DataFrame, counted: DataFrame, ts: str, order: str) -> DataFrame:
    """Newest counter and threshold of each machine that was counted."""
    last = counted.groupBy("machine_id").agg(
        F.max_by(F.struct("threshold", "anomaly_counter"), F.struct(ts, order)).alias("now")
    )
    return last.join(before, "machine_id", "left").select(
        "machine_id",
        F.coalesce("now.threshold", "threshold").alias("threshold"),
        F.coalesce("now.anomaly_counter", "counter").alias("counter"),
    )


def _check_complete(batch: DataFrame, done: int, batch_id: int) -> None:
    """Before the state moves on: stored, refused and threshold messages make up the micro-batch."""
    arrived = batch.count()
    if arrived != done:
        raise RuntimeError(f"micro-batch {batch_id}: {arrived} messages, {done} stored or refused")


@dataclass(frozen=True)
class MonitorJob:
    """Where a stream keeps its table, its state and the messages it refused."""

    table: str
    state: str
    rejected: str
    checkpoint: str
    ts: str = "ts"
    tie: str = "id"
    writer: int = writer_of(ORIGIN_STREAM)

    def _store(self, counted: DataFrame, raw: DataFrame, batch_id: int) -> int:
        """Append; returns the number of rows, counted by the write itself."""
        arrival = plan_chunks(raw, [], self.ts, self.tie)
        seen = Observation()
        rows = monitoring_rows(
            counted, ORIGIN_STREAM, batch_id, ts=self.ts, tie=self.tie, ingested_at=self.ts, writer=self.writer, chunks=arrival
        ).observe(seen, F.count(F.lit(1)).alias("rows"))
        append_monitoring(rows, self.table, batch_id, writer=self.writer)
        return seen.get.get("rows") or 0

    def _refuse(self, decoded: DataFrame, lost: DataFrame, batch_id: int) -> int:
        """What is not stored, with the reason: each message of the micro-batch is in one of the two tables."""
        kept = [c for c in ("value", "machine_id", self.ts, self.tie) if c in decoded.columns]
        bad = decoded.where("malformed").select(*kept, F.lit(MALFORMED).alias("reason"))
        refused = lost.where(F.col("reason").isNotNull()).select(*kept, "reason")
        seen = Observation()
        rows = bad.unionByName(refused).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(f"{self.rejected}/batch={batch_id}")
        return seen.get.get("rows") or 0

    @contextmanager
    def _kept(self, *frames: DataFrame) -> Iterator[None]:
        for frame in frames:
            frame.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield
        finally:
            for frame in frames:
                frame.unpersist()

    def start(self, decoded: DataFrame, scorer: Scorer | None, thresholds: DataFrame, **trigger) -> StreamingQuery:
        """Score a stream of decoded messages against fixed thresholds.

        ``scorer=None`` takes ``reconstruction_error`` from the messages.
        """
        states = MachineState(self.state)

        def handle(batch: DataFrame, batch_id: int) -> None:
            before = states.before(batch.sparkSession, batch_id, batch.select("machine_id").distinct())
            with self._kept(batch, before):
                chunks = plan_chunks(batch, ["machine_id"], self.ts, self.tie)
                judged = judge(accepted(batch), thresholds)
                start = before.select("machine_id", "counter")
                usable = judged.where(F.col("reason").isNull()).drop("reason")
                counted = count_anomalies(usable, self.ts, self.tie, start=start, chunks=chunks)
                with self._kept(counted):
                    done = self._store(counted, batch, batch_id) + self._refuse(batch, judged, batch_id)
                    _check_complete(batch, done, batch_id)
                    states.write(_changes(before, counted, self.ts, self.tie), batch_id)

        return self._run(scorer(decoded) if scorer else decoded, handle, **trigger)

    def start_with_control(self, events: DataFrame, scorer: Scorer | None, **trigger) -> StreamingQuery:
        """Score a stream that also carries threshold writes.

        ``events`` are decoded messages with a ``set_threshold`` column that is
        non-null on threshold writes. A write counts from its own time on and
        sets the machine's counter to 0.
        """
        states = MachineState(self.state)

        def handle(batch: DataFrame, batch_id: int) -> None:
            before = states.before(batch.sparkSession, batch_id, batch.select("machine_id").distinct())
            with self._kept(batch, before):
                good = accepted(batch)
                written = good.where(F.col("set_threshold").isNotNull()).select(
                    "machine_id",
                    F.col("set_threshold").alias("threshold"),
                    F.col(self.ts).alias("effective_at"),
                    self.tie,
                )
                readings = good.where(F.col("set_threshold").isNull()).drop("set_threshold")
                counted, refused = judge_with_history(readings, written, self.ts, self.tie, start=before)
                with self._kept(counted):
                    stored = counted.where(~F.col("is_control"))
                    done = self._store(stored, batch, batch_id) + self._refuse(batch, refused, batch_id)
                    _check_complete(batch, done + counted.where("is_control").count(), batch_id)
                    states.write(_changes(before, counted, self.ts, "event_order"), batch_id)

        return self._run(scorer(events) if scorer else events, handle, **trigger)

    def _run(self, stream: DataFrame, handle, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", self.checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


class Throughput(StreamingQueryListener):
    """Rows and seconds of all micro-batches since it was added with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rows, self.seconds, self.batches = 0, 0.0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.seconds += event.progress.durationMs.get("triggerExecution", 0) / 1000
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0
