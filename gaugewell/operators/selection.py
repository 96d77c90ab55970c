"""Exact medians and exact stratified splits without sorting a whole column in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.session import join_side, scratch_path

# Accuracy of the first, approximate pass; the second pass reads only values that near the middle.
_SKETCH = 2_000
_VALUE_BINS = 4_096
# Rows at a label's cut that one task sorts.
_RANKED = 100_000


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which NULL keys meet each other; the key columns come from ``left``."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in on])
    return left.join(other, same, how).drop(*[f"_same_{k}" for k in on])


def exact_medians(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact median (midpoint of the two middle values) per column; NULLs are skipped.

    Pass 1 sketches two quantiles just below and above the middle. Pass 2 counts
    the values under that bracket and groups the few inside it by value; the
    middle ranks are found in there. The bracket is checked against the ranks
    and widened if it misses one, so the result is exact for any data.
    Columns without a value get NULL. Result: ``by``, column, n, median.
    """
    by = by or []
    for margin in (2.0 / _SKETCH, 16.0 / _SKETCH, None):
        found = _bracketed_medians(rows, columns, by, margin)
        if by:
            # written once: read for the check and by whoever asked
            path = scratch_path(rows.sparkSession, "medians")
            found.write.parquet(path)
            found = rows.sparkSession.read.schema(found.schema).parquet(path)
            missed = not found.where(F.col("median").isNull() & (F.col("n") > 0)).isEmpty()
        else:
            # one record per column
            records = found.collect()
            missed = any(r["median"] is None and r["n"] > 0 for r in records)
            found = rows.sparkSession.createDataFrame(records, found.schema)
        if not missed:
            return found
    raise AssertionError("a bracket over the whole range cannot miss")


def _bin() -> Column:
    """The bin of a value, in the order of values; ``first`` and ``last`` are the ends of the finite ones.

    Infinities and NaN have bins of their own, as all values below the bracket (NULL) have; halves keep a
    wide range from overflowing.
    """
    value, first, last = F.col("value"), F.col("first"), F.col("last")
    span = last / 2 - first / 2
    return (
        F.when(value.isNull(), F.lit(-1))
        .when(F.isnan(value), F.lit(_VALUE_BINS + 3))
        .when(value == float("inf"), F.lit(_VALUE_BINS + 2))
        .when(value == float("-inf"), F.lit(0))
        .when(span > 0, 1 + F.floor((value / 2 - first / 2) / span * _VALUE_BINS))
        .otherwise(F.lit(1))
        .cast("long")
    )


def _bracketed_medians(rows: DataFrame, columns: list[str], by: list[str], margin: float | None) -> DataFrame:
    wanted = [] if margin is None else [0.5 - margin, 0.5 + margin]

    # expression texts: a wide table has many of them, and building them from parts costs a call per part
    def sketch(i: int, c: str) -> list[str]:
        value = f"CAST(`{c}` AS DOUBLE)"
        finite = f"if(abs({value}) < double('infinity'), {value}, NULL)"
        found = [f"count(`{c}`) AS n_{i}", f"min({finite}) AS min_{i}", f"max({finite}) AS max_{i}"]
        if wanted:
            found.append(f"percentile_approx(nanvl({value}, double('infinity')), array({wanted[0]}D, {wanted[1]}D), {_SKETCH}) AS q_{i}")
        return found

    def bracket(i: int, c: str) -> str:
        # NaN sorts above infinity and is covered only by a NaN bound
        lo, hi = "double('-infinity')", "double('nan')"
        if wanted:
            lo, hi = f"q_{i}[0]", f"if(q_{i}[1] = double('infinity'), {hi}, q_{i}[1])"
        # the finite values inside, between which the bins lie
        first, last = f"greatest({lo}, min_{i})", f"least({hi}, max_{i})"
        return f"named_struct('n', n_{i}, 'lo', {lo}, 'hi', {hi}, 'first', {first}, 'last', {last}) AS `{c}`"

    parts = ("n", "lo", "hi", "first", "last")
    sketches = rows.groupBy(*by).agg(*[F.expr(part) for i, c in enumerate(columns) for part in sketch(i, c)])
    if not by:
        # a single row, which stays on the driver from here on
        sketches = rows.sparkSession.createDataFrame([sketches.first()], sketches.schema)
    brackets = sketches.select(*by, *[F.expr(bracket(i, c)) for i, c in enumerate(columns)])
    if by:
        source = join_same(rows, brackets.select(*by, F.struct(*columns).alias("_bounds")), by)
        edges = {c: (F.col(f"_bounds.{c}.lo"), F.col(f"_bounds.{c}.hi")) for c in columns}
        each = [
            F.struct(F.lit(i).alias("idx"), F.lit(c).alias("column"), *[F.col(c)[p].alias(p) for p in parts])
            for i, c in enumerate(columns)
        ]
        long = brackets.select(*by, F.inline(F.array(*each)))
    else:
        # a single row with one bracket per column
        only = brackets.first()
        source = rows
        edges = {c: (F.lit(only[c]["lo"]).cast("double"), F.lit(only[c]["hi"]).cast("double")) for c in columns}
        listed = [(i, c, *[only[c][p] for p in parts]) for i, c in enumerate(columns)]
        long = F.broadcast(
            rows.sparkSession.createDataFrame(listed, "idx int, column string, n long, lo double, hi double, first double, last double")
        )

    def near(i: int, c: str):
        v, (lo, hi) = F.col(c).cast("double"), edges[c]
        return F.when(v <= hi, F.struct(F.lit(i).alias("idx"), F.when(v >= lo, v).alias("value")))

    # values under the bracket share the NULL group, so they cost one record per task
    group = [*by, "idx"]
    counts = (
        source.select(*by, F.explode(F.array(*[near(i, c) for i, c in enumerate(columns)])).alias("s"))
        .where(F.col("s").isNotNull())
        .groupBy(*by, F.col("s.idx").alias("idx"), F.col("s.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("k"))
    )
    binned = join_same(counts, long, group).withColumn("bin", _bin())

    # ranks are 0-based; the two middle ranks coincide for an odd count
    first_rank, second_rank = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    in_order = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = (
        binned.groupBy(*group, "bin")
        .agg(F.sum("k").alias("rows"), F.first("n").alias("n"))
        .withColumn("start", F.coalesce(F.sum("rows").over(in_order), F.lit(0)))
        .where((F.col("start") <= second_rank) & (F.col("start") + F.col("rows") > first_rank))
        .select(*group, "bin", "start")
    )
    by_value = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_same(binned, per_bin, [*group, "bin"]).withColumn(
        "at", F.col("start") + F.coalesce(F.sum("k").over(by_value), F.lit(0))
    )

    def value_at(rank):
        covers = (F.col("at") <= rank) & (F.col("at") + F.col("k") > rank)
        return F.max(F.when(covers, F.col("value")))

    middle = placed.groupBy(*group).agg(value_at(first_rank).alias("a"), value_at(second_rank).alias("b"))
    a, b = F.col("a"), F.col("b")
    median = F.when(a == b, a).otherwise(a + (b - a) / 2)
    return join_same(long, middle, group, "left").select(*by, "column", "n", median.alias("median"))


def stratified_split(
    rows: DataFrame, label: str, tie: str, fraction: float = 0.3, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Mark exactly ``round(fraction * n)`` rows of every label as test rows.

    The test rows are those with the smallest hash of (tie, seed). The cut-off
    hash per label comes from counts per hash prefix, then from sorting only the
    rows that share the prefix at the cut; no label is ever sorted as a whole.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.col(tie), F.lit(seed))))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = hashed.groupBy(label, "_prefix").count()
    every = Window.partitionBy(label)
    up_to = every.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.withColumns({"total": F.sum("count").over(every), "upto": F.sum("count").over(up_to)})
        .withColumn("need", F.round(F.lit(fraction) * F.col("total")).cast("long") - (F.col("upto") - F.col("count")))
        .where((F.col("need") > 0) & (F.col("need") <= F.col("count")))
        .select(label, "_prefix", "need")
    )
    narrow = hashed.select(label, tie, "_hash", "_prefix")
    at_cut = join_same(narrow, join_side(cuts), [label, "_prefix"])
    # a longer prefix leaves fewer rows at the cut: four more digits at a time, until one task can rank them
    digits = 4
    while digits < 32 and (at_cut.groupBy(label).count().agg(F.max("count")).first()[0] or 0) > _RANKED:
        digits += 4
        longer = at_cut.withColumn("_longer", F.substring("_hash", 1, digits))
        sizes = longer.groupBy(label, "need", "_longer").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("_longer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = sizes.withColumn("_left", F.col("need") - before).where((F.col("_left") > 0) & (F.col("_left") <= F.col("count")))
        at_cut = join_same(longer.drop("need"), join_side(left.select(label, "_longer", F.col("_left").alias("need"))), [label, "_longer"]).drop("_longer")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash", tie))
    edge = (
        at_cut.withColumn("_rank", rank).where(F.col("_rank") == F.col("need")).select(label, F.struct("_hash", tie).alias("_cut"))
    )
    marked = join_same(hashed, join_side(edge), [label], "left")
    inside = F.struct("_hash", tie) <= F.col("_cut")
    return marked.withColumn(name, F.coalesce(inside, F.lit(False))).drop("_hash", "_prefix", "_cut")


def not_null(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column; NaN rows stay."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns or rows.columns]))
