"""Batches in arrival order, closed by count or by time, and the counter stored with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gaugewell.functions.scalar import epoch_micros
from gaugewell.operators.ordering import MIN_CHUNK_ROWS, row_sequence
from gaugewell.schema import BATCH_SIZE, BATCH_TIMEOUT_MS

_SEGMENT, _TIME, _ENTRY, _BEFORE = "_segment", "_time", "_entry", "_before"


def assign_batches(rows: DataFrame, ts: str = "ts", tie: str = "id", size: int = BATCH_SIZE, **chunking) -> DataFrame:
    """Number the rows in arrival order (``seq`` from 1) and close a batch every ``size`` rows."""
    numbered = row_sequence(rows, [], ts, tie, "seq", **chunking)
    return numbered.withColumn("batch_id", F.floor((F.col("seq") - 1) / F.lit(size)).cast("long"))


def assign_timed_batches(
    rows: DataFrame,
    ts: str = "ts",
    tie: str = "id",
    size: int = BATCH_SIZE,
    timeout_ms: int = BATCH_TIMEOUT_MS,
    min_rows: int = MIN_CHUNK_ROWS,
    pieces: int | None = None,
) -> DataFrame:
    """Number the rows (``seq``) and close a batch at ``size`` rows or ``timeout_ms`` after its first one.

    A row that arrives just ``timeout_ms`` after the first one opens the next
    batch. Where a batch starts depends on where the one before it did, back to
    the first row. But a batch has at most ``size`` rows, so of a segment of
    neighbouring rows all that matters is how many of its first rows belong to the
    batch before: each segment is summarised, for each of the ``size`` possible
    numbers, by the number it hands on and the batches it starts. The summaries, one
    a segment and ``pieces`` at most, are followed once from the first to the
    last; then the segments are cut independently, with two integers sent to
    Python for each row.

    Rows without a time come first, as rows of one instant.
    """
    pieces = pieces or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    share = max(min_rows, size, -(-total // pieces))
    numbered = row_sequence(rows, [], ts, tie, "seq", min_rows=min_rows, pieces=pieces)
    timed = numbered.withColumns({
        _SEGMENT: F.floor((F.col("seq") - 1) / share).cast("long"),
        _TIME: F.coalesce(epoch_micros(F.col(ts)), F.lit(-(1 << 62))),
    })
    entries = _entries(timed, share, size, timeout_ms * 1000)
    entered = timed.join(F.broadcast(entries), _SEGMENT)
    ordered = entered.repartition(_SEGMENT).sortWithinPartitions(_SEGMENT, "seq")
    batch = _cut(F.col(_SEGMENT), F.col(_TIME), F.col(_ENTRY), F.col(_BEFORE), size, timeout_ms * 1000)
    return ordered.withColumn("batch_id", batch).drop(_SEGMENT, _TIME, _ENTRY, _BEFORE)


def _following(time: np.ndarray, size: int, timeout: int) -> np.ndarray:
    """Of a batch that starts at each row, the first row after it."""
    return np.minimum(np.arange(len(time)) + size, np.searchsorted(time, time + timeout, "left"))


def _entries(timed: DataFrame, share: int, size: int, timeout: int) -> DataFrame:
    """(segment, entry, before): the rows at its start that belong to an earlier batch, and the batches started before it."""
    names = (_SEGMENT, "entry", "exit", "starts")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            segment = table.column(0).to_numpy()
            edges = np.flatnonzero(segment[1:] != segment[:-1]) + 1
            for a, b in zip([0, *edges], edges):
                yield summary(segment[a], table.column(1).slice(a, b - a).to_numpy())
            held = table.slice(edges[-1] if len(edges) else 0).to_batches()
        if held and sum(map(len, held)):
            table = pa.Table.from_batches(held)
            yield summary(table.column(0)[0].as_py(), table.column(1).to_numpy())

    def summary(segment: int, time: np.ndarray) -> pa.RecordBatch:
        # rows from ``share`` on are the first ones of the next segment
        inside = min(share, len(time))
        jump, starts = np.minimum(_following(time, size, timeout), len(time)), np.ones(len(time), dtype=np.int64)
        jump[inside:], starts[inside:] = np.arange(inside, len(time)), 0
        jump, starts = np.append(jump, len(time)), np.append(starts, 0)
        while (jump[:inside] < inside).any():
            starts, jump = starts + starts[jump], jump[jump]
        entry = np.arange(min(size, inside))
        columns = [np.full(len(entry), segment), entry, jump[entry] - inside, starts[entry]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    # the first rows of a segment also go to the one before it, whose last batch may take them in
    place = F.pmod(F.col("seq") - 1, F.lit(share))
    copies = F.when((place < size) & (F.col(_SEGMENT) > 0), F.array(F.col(_SEGMENT) - 1, F.col(_SEGMENT))).otherwise(F.array(_SEGMENT))
    halo = timed.select("seq", _TIME, F.explode(copies).alias(_SEGMENT)).repartition(_SEGMENT).sortWithinPartitions(_SEGMENT, "seq")
    maps = halo.select(_SEGMENT, _TIME).mapInArrow(summarise, ", ".join(f"{n} long" for n in names))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, tuple[int, int]]] = {}
        for batch in batches:
            for segment, entry, leave, starts in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(segment, {})[entry] = (leave, starts)
        entry, before, rows = 0, 0, []
        for segment in sorted(found):
            rows.append((segment, entry, before))
            # a segment all of whose rows belong to the batch before is the last one
            leave, starts = found[segment].get(entry, (0, 0))
            entry, before = leave, before + starts
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[_SEGMENT, _ENTRY, _BEFORE])

    # ``size`` small rows for each of ``pieces`` segments
    return maps.coalesce(1).mapInArrow(follow, f"{_SEGMENT} long, {_ENTRY} long, {_BEFORE} long")


def _cut(segment: Column, time: Column, entry: Column, before: Column, size: int, timeout: int) -> Column:
    """The batch of each row of a task, whose rows are sorted by segment and arrival."""

    @arrow_udf("long")
    def batches(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, start, number, until = None, 0, 0, 0  # of the open batch: rows so far, number, end of its time
        for part, when, first, count in columns:
            parts, times = part.to_numpy(), when.to_numpy()
            out = np.zeros(len(parts), dtype=np.int64)
            edges = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(parts)]):
                mine = times[a:b]
                if a == b:
                    continue
                if parts[a] != last:
                    last = parts[a]
                    number, at = int(count[a].as_py()) - 1, int(first[a].as_py())
                    # a batch from before is only followed to its end
                    start, until = size - at, np.iinfo(np.int64).max
                at = min(size - start, int(np.searchsorted(mine, until, "left")))
                opens = np.zeros(len(mine), dtype=np.int64)
                following = _following(mine, size, timeout)
                if at >= len(mine):
                    start += len(mine)
                while at < len(mine):
                    opens[at] = 1
                    start, until = len(mine) - at, int(mine[at]) + timeout
                    at = int(following[at])
                out[a:b] = number + np.cumsum(opens)
                number = int(out[b - 1])
            yield pa.array(out)

    return batches.asNondeterministic()(segment, time, entry, before)


def batch_last_counter(rows: DataFrame, name: str = "stored_counter") -> DataFrame:
    """The counter of the batch's last row on every row of the batch.

    The window is over one batch, which holds at most ``size`` rows.
    """
    whole = Window.partitionBy("batch_id")
    return rows.withColumn(name, F.max_by("anomaly_counter", "seq").over(whole))
