"""The bounded anomaly counter: up on an anomaly, down otherwise, within [0, limit].

Every step has the form ``x -> min(h, max(l, x + s))``. Such functions compose
to one of the same form, so a chunk of a long history shrinks to three numbers
and the chunks of a split machine can be counted in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema

from gaugewell.operators.ordering import CHUNK, SPLIT, ChunkPlan, plan_chunks
from gaugewell.schema import COUNTER_LIMIT

Steps = tuple[np.ndarray, np.ndarray, np.ndarray]

# Step codes. CARRY sets the counter to the value it brings along.
UP, DOWN, RESET, CARRY = 1, -1, 0, 2
_STEP, _CARRIED, _FIRST, _KEY = "_step", "_carried", "_rank", "_key"


def bounded_counter(
    rows: DataFrame,
    machine: str = "machine_id",
    ts: str = "ts",
    tie: str = "id",
    step: str = "step",
    name: str = "anomaly_counter",
    start: DataFrame | None = None,
    limit: int = COUNTER_LIMIT,
    chunks: ChunkPlan | None = None,
    placed: bool = False,
    **chunking,
) -> DataFrame:
    """Add the counter after each row, in (ts, tie) order per machine.

    ``step`` holds UP, DOWN or RESET. ``start`` (machine, counter) gives
    counters to begin with; machines not in it begin at 0. Rows are shuffled
    once on (machine, chunk) and replayed in order; only the key and the step of
    a row travel to Python, in a stream of Arrow batches, and the counter comes
    back beside it. Only machines too large for one task are first summarised per
    chunk. ``placed`` says that ``chunks.place`` was applied already.
    """
    plan = chunks or plan_chunks(rows, [machine], ts, tie, **chunking)
    stepped = rows.withColumn(_STEP, F.col(step).cast("int"))
    cut = stepped if placed else plan.assign(stepped)
    carried = None
    if start is not None:
        carried = start.select(
            F.col(machine), F.lit(0).cast("long").alias(CHUNK), F.col("counter").cast("int").alias(_CARRIED)
        )
    if plan.bins is not None:
        edges = _chunk_starts(cut.where(SPLIT), plan.bins.select(machine).distinct(), machine, ts, tie, carried, limit)
        carried = edges if carried is None else carried.unionByName(edges)

    body = cut.drop(SPLIT).withColumns({_FIRST: F.lit(1), _CARRIED: F.lit(None).cast("int")})
    if carried is not None:
        head = carried.withColumns({_FIRST: F.lit(0), _STEP: F.lit(CARRY)})
        body = body.unionByName(head, allowMissingColumns=True)
    if carried is not None or not placed:
        body = body.repartition(*plan.groups)
    ordered = body.sortWithinPartitions(machine, CHUNK, _FIRST, ts, tie)
    counted = ordered.withColumn(name, _replay(F.col(machine), F.col(CHUNK), F.col(_STEP), F.col(_CARRIED), limit))
    # a carried value is no row and has no counter; a filter on the step would be moved below the replay
    return counted.where(F.col(name).isNotNull()).drop(CHUNK, _FIRST, _STEP, _CARRIED)


def _replay(machine: Column, chunk: Column, step: Column, carried: Column, limit: int) -> Column:
    """The counter after each row of a task, whose rows are sorted; NULL for carried values."""

    @arrow_udf("int")
    def counters(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keys, x = _Keys(_KEY), 0
        for key, part, code, value in batches:
            if not len(key):
                yield pa.array([], pa.int32())
                continue
            begins = keys.begins(pa.RecordBatch.from_arrays([key, part], names=[_KEY, CHUNK]))
            codes = _numbers(code)
            shift, low, high = _scan(_steps(codes, _numbers(value), limit), _segments(begins))
            # the first rows may go on with the group of the last batch
            entry = np.where(np.cumsum(begins) == 0, x, 0)
            out = np.minimum(high, np.maximum(low, entry + shift))
            x = int(out[-1])
            yield pa.array(out, pa.int32(), mask=codes == CARRY)

    return counters.asNondeterministic()(machine, chunk, step, carried)


class _Keys:
    """Finds the rows that open a new (machine, chunk); NULL keys are one machine."""

    def __init__(self, machine: str) -> None:
        self.names = (machine, CHUNK)
        self.last: pa.RecordBatch | None = None

    def begins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, dtype=bool)
        out[0] = self.last is None
        for name in self.names:
            column = batch.column(name)
            out[1:] |= _differ(column.slice(1), column.slice(0, len(column) - 1))
            if self.last is not None:
                out[:1] |= _differ(column.slice(0, 1), self.last.column(name))
        self.last = batch.slice(batch.num_rows - 1)
        return out


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(code: np.ndarray, carried: np.ndarray, limit: int) -> Steps:
    """Each row's step as (shift, low, high)."""
    fixed = (code == RESET) | (code == CARRY)
    value = np.where(code == CARRY, carried, 0)
    return np.where(fixed, 0, code), np.where(fixed, value, 0), np.where(fixed, value, limit)


def _then(f: Steps, g: Steps) -> Steps:
    """First ``f``, then ``g``, as one step of the same form."""
    shift, low, high = g
    return f[0] + shift, np.minimum(high, np.maximum(low, f[1] + shift)), np.minimum(high, np.maximum(low, f[2] + shift))


def _segments(begins: np.ndarray) -> np.ndarray:
    """Of each row, the first row of its group in this batch."""
    at = np.where(begins, np.arange(len(begins)), 0)
    return np.maximum.accumulate(at)


def _scan(steps: Steps, start: np.ndarray) -> Steps:
    """Each row's step composed with all earlier ones of its group, in log(n) rounds over the batch."""
    n, reach = len(start), 1
    depth = np.arange(n) - start
    while reach <= (depth.max() if n else 0):
        joined = _then(tuple(s[:-reach] for s in steps), tuple(s[reach:] for s in steps))
        inside = depth[reach:] >= reach
        steps = tuple(np.concatenate([s[:reach], np.where(inside, j, s[reach:])]) for s, j in zip(steps, joined))
        reach *= 2
    return steps


def _chunk_starts(
    rows: DataFrame, split: DataFrame, machine: str, ts: str, tie: str, carried: DataFrame | None, limit: int
) -> DataFrame:
    """Counter at the start of every chunk but the first of the split machines."""
    narrow = (
        rows.select(machine, CHUNK, ts, tie, _STEP)
        .repartition(machine, CHUNK)
        .sortWithinPartitions(machine, CHUNK, ts, tie)
        .select(machine, CHUNK, _STEP)
    )
    key = narrow.schema[machine]
    parts = [T.StructField(n, T.LongType()) for n in ("shift", "low", "high")]
    summary = T.StructType([key, T.StructField(CHUNK, T.LongType()), *parts])
    arrow = to_arrow_schema(summary)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, open_ = _Keys(machine), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            before, begins = keys.last, keys.begins(batch)
            code = _numbers(batch.column(_STEP))
            first = np.cumsum(begins) == 0
            found = _scan(_steps(code, code, limit), _segments(begins))
            if open_ is not None:
                gone_on = _then(tuple(np.full(len(code), v) for v in open_), found)
                found = tuple(np.where(first, g, f) for g, f in zip(gone_on, found))
            # a group ends before each row that begins one
            ends = np.flatnonzero(begins[1:])
            if begins[0] and before is not None:
                yield out(before, [np.array([v]) for v in open_])
            if len(ends):
                yield out(batch.take(pa.array(ends)), [f[ends] for f in found])
            open_ = [f[-1] for f in found]
        if open_ is not None:
            yield out(keys.last, [np.array([v]) for v in open_])

    def out(rows: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
        columns = [rows.column(machine), rows.column(CHUNK), *map(pa.array, values)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    summaries = narrow.mapInArrow(summarise, summary)
    if carried is not None:
        # a known start value is the step that ignores its input
        known = carried.join(F.broadcast(split), machine, "left_semi")
        value = F.col(_CARRIED).cast("long")
        summaries = summaries.unionByName(
            known.select(
                machine,
                F.lit(-1).cast("long").alias(CHUNK),
                F.lit(0).cast("long").alias("shift"),
                value.alias("low"),
                value.alias("high"),
            )
        )
    # one record per chunk: a few thousand in all
    ordered = summaries.repartition(machine).sortWithinPartitions(machine, CHUNK)
    out_schema = T.StructType([key, T.StructField(CHUNK, T.LongType()), T.StructField(_CARRIED, T.IntegerType())])
    arrow_out = to_arrow_schema(out_schema)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        machines = _differ(table.column(machine).slice(1), table.column(machine).slice(0, table.num_rows - 1))
        begins = np.concatenate([[True], machines])
        shift, low, high = _scan(tuple(_numbers(table.column(n)) for n in ("shift", "low", "high")), _segments(begins))
        after = np.minimum(high, np.maximum(low, shift))
        before = np.where(begins, 0, np.concatenate([[0], after[:-1]]))
        columns = [table.column(machine), table.column(CHUNK), pa.array(before)]
        rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_out)], schema=arrow_out)
        yield rows.filter(pc.greater(rows.column(CHUNK), 0))

    return ordered.mapInArrow(compose, out_schema)
