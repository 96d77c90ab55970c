"""Ordered work on histories where one machine may own a large share of the rows.

A window partitioned by machine puts a machine's whole history in one task.
Here a machine that is too large for that is cut along time into *chunks*;
ordinary machines keep a single chunk. Operators then work per
(machine, chunk) and carry a small value from chunk to chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.scalar import epoch_micros
from gaugewell.session import join_side

CHUNK = "_chunk"
SPLIT = "_split"
_BIN = "_bin"

# Rows of a key that one task may hold in order; more are cut into chunks of this size.
MIN_CHUNK_ROWS = 50_000
BIN_HOURS = 1
_MICROS = BIN_HOURS * 3_600_000_000
# An hour that is too large is cut at these quantiles; 2**10 - 1 of them make a 10-step binary search.
_QUANTILE_STEPS = [1 << k for k in range(9, -1, -1)]
_QUANTILES = [i / 1024 for i in range(1, 1024)]
_QUANTILE_ROWS = 2_000


@dataclass(frozen=True)
class ChunkPlan:
    """How to cut the histories of the large keys; ``bins`` is None if there are none.

    A plan may be used for any subset of the rows it was made from, so it can
    be made once from the raw input and shared by the operators behind it.
    """

    keys: tuple[str, ...]
    ts: str
    tie: str
    bins: DataFrame | None
    cuts: DataFrame | None = None

    @property
    def groups(self) -> list[str]:
        """Columns that keep together what has to be ordered together."""
        return list(self.keys) if self.bins is None else [*self.keys, CHUNK]

    def place(self, rows: DataFrame) -> DataFrame:
        """Assign chunks and shuffle once; the ordered operators behind it need no further shuffle."""
        cut = self.assign(rows)
        return cut.repartition(*self.groups) if self.groups else cut.coalesce(1)

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add the chunk number (a function of the row alone) and whether its key is split."""
        if self.bins is None:
            return rows.withColumns({CHUNK: F.lit(0).cast("long"), SPLIT: F.lit(False)})
        micros = epoch_micros(F.col(self.ts))
        on = [*self.keys, _BIN]
        joined = rows.withColumn(_BIN, _bin(micros)).join(self.bins, on, "left")
        base = F.col("_base")
        if self.cuts is not None:
            joined = joined.join(self.cuts, on, "left")
            place = _place(micros, F.col(self.tie), F.col("_from"))
            passed = F.aggregate(
                F.array(*[F.lit(n) for n in _QUANTILE_STEPS]),
                F.lit(0),
                lambda at, step: at + F.when(F.get(F.col("_cuts"), at + step - 1) <= place, step).otherwise(F.lit(0)),
            )
            piece = F.floor(passed * F.col("_from.pieces") / 1024).cast("long")
            base = base + F.when(F.col("_cuts").isNotNull(), piece).otherwise(F.lit(0))
        chunk = F.coalesce(base, F.lit(0).cast("long"))
        return joined.withColumns({CHUNK: chunk, SPLIT: F.col("_base").isNotNull()}).drop(_BIN, "_base", "_from", "_cuts")


def _bin(micros: Column) -> Column:
    return F.floor(micros / F.lit(_MICROS)).cast("long")


def _place(micros: Column, tie: Column, origin: Column) -> Column:
    """(time, tie) of one hour as a single number that keeps the order: whole microseconds plus a fraction."""
    return (micros - origin["t0"]).cast("double") + (tie - origin["i0"]).cast("double") / origin["ties"]


def plan_chunks(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    min_rows: int = MIN_CHUNK_ROWS,
    pieces: int | None = None,
) -> ChunkPlan:
    """Find the keys that hold more than one task's share of the rows and cut them.

    The share is ``max(min_rows, total / pieces)`` rows, so fewer than
    ``pieces`` keys can exceed it, and only those few counts reach the driver.
    Their rows are counted per hour and hours are packed into chunks up to the
    share. An hour that is itself too large is cut at quantiles of (ts, tie),
    so bursts and rows of one instant are spread as well. Reads the key, time
    and tie columns only; ``tie`` is a whole number.
    """
    spark = rows.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(*keys, epoch_micros(F.col(ts)).alias("_t"), F.col(tie).cast("long").alias("_i"))

    # counts first, so that the roll-up to the total works on one record per key
    per_key = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = (
        per_key.select("n", F.struct(*[F.col(k) for k in keys] or [F.lit(0)]).alias("k"))
        .rollup("k")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
        .orderBy(F.desc("level"), F.desc("n"))
        .limit(pieces + 1)
        .collect()
    )
    total = largest[0]["n"] if largest else 0
    share = max(min_rows, -(-total // pieces))
    large = [r["k"] for r in largest if r["level"] == 0 and r["n"] > share]
    if not large:
        return ChunkPlan(tuple(keys), ts, tie, None)

    if keys:
        listed = spark.createDataFrame([tuple(k) for k in large], narrow.select(*keys).schema)
        narrow = narrow.join(F.broadcast(listed), keys, "left_semi")
    narrow = narrow.withColumn(_BIN, _bin(F.col("_t")))
    on = [*keys, _BIN]
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(_BIN).rowsBetween(Window.unboundedPreceding, -1))
    origin = F.struct(
        F.ceil(F.col("n") / F.lit(share)).cast("long").alias("pieces"),
        F.col("t0"),
        F.col("i0"),
        (F.col("i1") - F.col("i0") + 1).cast("double").alias("ties"),
    )
    hours = (
        narrow.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("t0"), F.min("_i").alias("i0"), F.max("_i").alias("i1"))
        .select(*on, "n", F.floor(F.coalesce(before, F.lit(0)) / F.lit(share)).cast("long").alias("_base"), origin.alias("_from"))
    )
    hours = join_side(hours)
    bins = hours.select(*on, "_base")
    # fewer than ``pieces`` hours can be too large
    full = hours.where(F.col("n") > share).select(*on, "_from")
    if full.isEmpty():
        return ChunkPlan(tuple(keys), ts, tie, bins)
    cuts = (
        narrow.join(F.broadcast(full), on)
        .groupBy(*on, "_from")
        .agg(F.percentile_approx(_place(F.col("_t"), F.col("_i"), F.col("_from")), _QUANTILES, F.lit(10_000)).alias("_cuts"))
    )
    return ChunkPlan(tuple(keys), ts, tie, bins, join_side(cuts, _QUANTILE_ROWS))


def row_sequence(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    name: str = "seq",
    chunks: ChunkPlan | None = None,
    **chunking,
) -> DataFrame:
    """Gap-free 1-based number in (ts, tie) order, per key or (no keys) over all rows.

    Rows are numbered inside their chunk; chunks of a split key are shifted by
    the rows before them. There are at most twice ``pieces`` such chunks.
    """
    plan = chunks or plan_chunks(rows, keys, ts, tie, **chunking)
    cut = plan.assign(rows)
    local = F.row_number().over(Window.partitionBy(*plan.groups).orderBy(ts, tie)).cast("long")
    if plan.bins is None:
        return cut.withColumn(name, local).drop(CHUNK, SPLIT)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.where(SPLIT)
        .groupBy(*keys, CHUNK)
        .count()
        .select(*keys, CHUNK, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    )
    numbered = cut.withColumn("_local", local).join(F.broadcast(shifts), [*keys, CHUNK], "left")
    return numbered.withColumn(name, F.col("_local") + F.coalesce("_shift", F.lit(0))).drop(
        CHUNK, SPLIT, "_local", "_shift"
    )


def carry_value(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    value: str,
    name: str,
    forward: bool = True,
    chunks: ChunkPlan | None = None,
    placed: bool = False,
    **chunking,
) -> DataFrame:
    """Newest non-null ``value`` up to each row, or with ``forward=False`` the next one from it on.

    One shuffle on (key, chunk). A split key gets, per chunk, the value that
    crosses the chunk's edge; there are at most twice ``pieces`` of those.
    ``placed`` says that ``chunks.place`` was applied; its columns then stay.
    """
    plan = chunks or plan_chunks(rows, keys, ts, tie, **chunking)
    cut = rows if placed else plan.assign(rows)
    extra = [] if placed else [CHUNK, SPLIT]
    # the next value is the newest one when read backwards; a frame that runs to the
    # end of the group would be evaluated anew for every row
    toward = F.asc if forward else F.desc
    so_far = Window.partitionBy(*plan.groups).orderBy(toward(ts), toward(tie)).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(value, ignorenulls=True).over(so_far)
    if plan.bins is None:
        return cut.withColumn(name, local).drop(*extra)
    nearest = F.max_by if forward else F.min_by
    present = F.when(F.col(value).isNotNull(), F.struct(ts, tie))
    edges = cut.where(SPLIT).groupBy(*keys, CHUNK).agg(nearest(F.col(value), present).alias("_edge"))
    passed = Window.partitionBy(*keys).orderBy(toward(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    crossing = F.last("_edge", ignorenulls=True).over(passed)
    edges = edges.select(*keys, CHUNK, crossing.alias("_cross"))
    filled = cut.withColumn("_local", local).join(F.broadcast(edges), [*keys, CHUNK], "left")
    return filled.withColumn(name, F.coalesce("_local", "_cross")).drop(*extra, "_local", "_cross")
