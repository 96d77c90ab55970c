"""Rows before and around breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.scalar import epoch_micros
from gaugewell.operators.ordering import carry_value, row_sequence
from gaugewell.schema import BROKEN, EXCLUDE_HOURS_BEFORE, NORMAL, WINDOW_HOURS_AFTER, WINDOW_HOURS_BEFORE

_HOUR = 3_600_000_000
_AT, _SLOT = "_at", "_slot"


def _slot(micros, width: int):
    return F.floor(micros / F.lit(width)).cast("long")


def exclude_before_failure(
    rows: DataFrame,
    ts: str = "timestamp",
    status: str = "machine_status",
    machine: str | None = None,
    hours: float = EXCLUDE_HOURS_BEFORE,
) -> DataFrame:
    """NORMAL rows that have no breakdown in ``[ts, ts + hours]``.

    Time is cut into slots of ``hours``. A breakdown that matters to a row lies
    in the row's slot, where only the latest one counts, or in the next slot,
    where only the earliest one counts. So breakdowns shrink to two times per
    slot before they are joined, and each row meets at most one record.
    """
    width = int(hours * _HOUR)
    keys = [machine] if machine else []
    failures = rows.where(F.col(status) == BROKEN).select(*keys, epoch_micros(F.col(ts)).alias(_AT))
    slot = _slot(F.col(_AT), width)
    none = F.lit(None).cast("long")
    per_slot = (
        failures.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(slot.alias(_SLOT), F.col(_AT).alias("latest"), none.alias("following")),
                    F.struct((slot - 1).alias(_SLOT), none.alias("latest"), F.col(_AT).alias("following")),
                )
            ),
        )
        .groupBy(*keys, _SLOT)
        .agg(F.max("latest").alias("latest"), F.min("following").alias("following"))
    )
    kept = rows.where(F.col(status) == NORMAL).withColumn(_AT, epoch_micros(F.col(ts)))
    kept = kept.withColumn(_SLOT, _slot(F.col(_AT), width))
    same = kept[_SLOT] == per_slot[_SLOT]
    for k in keys:
        same = same & (kept[k] == per_slot[k])
    near = (per_slot["latest"] >= kept[_AT]) | (per_slot["following"] <= kept[_AT] + F.lit(width))
    return kept.join(per_slot, same & near, "left_anti").drop(_AT, _SLOT)


def next_failure(
    rows: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    status: str = "machine_status",
    machine: str | None = None,
    name: str = "next_failure",
    **chunking,
) -> DataFrame:
    """Add the time of the first breakdown at or after each row."""
    broken = F.col(status) == BROKEN
    # among rows of one instant the breakdown comes last, so that all of them see it
    rank = F.when(broken, F.lit(1 << 61)).otherwise(F.lit(0)) + F.col(tie).cast("long")
    staged = rows.withColumns({"_order": rank, "_failed": F.when(broken, F.col(ts))})
    keys = [machine] if machine else []
    return carry_value(staged, keys, ts, "_order", "_failed", name, forward=False, **chunking).drop("_order", "_failed")


def exclude_before_failure_ordered(
    rows: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    status: str = "machine_status",
    machine: str | None = None,
    hours: float = EXCLUDE_HOURS_BEFORE,
    **chunking,
) -> DataFrame:
    """The same rows as ``exclude_before_failure``, through the next failure's time."""
    ahead = next_failure(rows, ts, tie, status, machine, "_next", **chunking)
    gap = epoch_micros(F.col("_next")) - epoch_micros(F.col(ts))
    clear = F.col("_next").isNull() | (gap > F.lit(int(hours * _HOUR)))
    return ahead.where((F.col(status) == NORMAL) & clear).drop("_next")


def breakdown_windows(
    rows: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    status: str = "machine_status",
    machine: str | None = None,
    before: float = WINDOW_HOURS_BEFORE,
    after: float = WINDOW_HOURS_AFTER,
    **chunking,
) -> DataFrame:
    """Rows from ``before`` hours ahead of each breakdown to ``after`` hours behind it.

    Breakdowns are numbered from 1 in time order. A row appears once per
    window it lies in. The range join is an equality join on time slots: a
    breakdown is listed under the few slots its window touches, a row has
    exactly one slot, so pairs outside the window stay rare and none repeats.
    """
    keys = [machine] if machine else []
    ahead, behind = int(before * _HOUR), int(after * _HOUR)
    width = max(1, (ahead + behind) // 4)
    broken = rows.where(F.col(status) == BROKEN).select(*keys, ts, tie)
    numbered = row_sequence(broken, keys, ts, tie, "breakdown_nb", **chunking)
    centre = epoch_micros(F.col(ts))
    windows = numbered.select(
        *keys,
        F.col("breakdown_nb"),
        F.col(ts).alias("breakdown_at"),
        centre.alias("_centre"),
        F.explode(
            F.sequence(_slot(centre - F.lit(ahead), width), _slot(centre + F.lit(behind), width))
        ).alias(_SLOT),
    )
    staged = rows.withColumn(_AT, epoch_micros(F.col(ts)))
    staged = staged.withColumn(_SLOT, _slot(F.col(_AT), width))
    inside = (F.col(_AT) >= F.col("_centre") - F.lit(ahead)) & (F.col(_AT) <= F.col("_centre") + F.lit(behind))
    return staged.join(windows, [*keys, _SLOT]).where(inside).drop(_AT, _SLOT, "_centre")
