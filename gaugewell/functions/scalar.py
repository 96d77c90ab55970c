"""Scalar rules of the monitoring job as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewell.schema import BASE_COLOUR, COUNTER_STEPS, ERROR_STEPS

# The number texts a sender accepts. Everything else counts as 0.
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
HEX_TEXT = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z"
SPECIAL_TEXT = r"(?i)^([+-]?(inf|infinity)|nan)\z"

# Fixed value: the largest 32-bit float, which stands in for infinity after training-side scaling.
FLOAT32_MAX = 3.4028234663852886e38


def parse_or_zero(text: Column) -> Column:
    """Text to double; empty, malformed and overflowing text becomes 0."""
    value = text.try_cast("double")
    number = text.rlike(DECIMAL_TEXT) | text.rlike(HEX_TEXT)
    return (
        F.when(number & (F.abs(value) < F.lit(float("inf"))), value)
        .when(text.rlike(SPECIAL_TEXT), value)
        .otherwise(F.lit(0.0))
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with and without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def round_to_second(ts: Column) -> Column:
    """Nearest whole second, halves up."""
    shifted = epoch_micros(ts) + F.lit(500_000)
    return F.timestamp_micros(shifted - F.pmod(shifted, F.lit(1_000_000)))


def fill_null(value: Column, default) -> Column:
    """Replace NULL only; NaN stays."""
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def anomaly_flag(error: Column, threshold: Column) -> Column:
    """Strictly above the threshold; NaN is never an anomaly."""
    return (error > threshold) & ~F.isnan(error)


def _severity(value: Column, steps) -> Column:
    band = F.lit(BASE_COLOUR)
    for bound, colour in steps:
        band = F.when((value >= F.lit(bound)) & ~F.isnan(value.cast("double")), F.lit(colour)).otherwise(band)
    return band


def severity_error(error: Column) -> Column:
    return _severity(error, ERROR_STEPS)


def severity_counter(counter: Column) -> Column:
    return _severity(counter, COUNTER_STEPS)


def scale_train(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling as in training: NaN, 0/0 and a sensor without range become 0, infinities the float32 limits."""
    shifted = x - low
    ratio = F.nanvl(F.try_divide(shifted, high - low), F.lit(0.0))
    bounded = F.least(F.greatest(ratio, F.lit(-FLOAT32_MAX)), F.lit(FLOAT32_MAX))
    # no ratio: the range is zero, and only the direction is left
    direction = F.nanvl(F.signum(shifted), F.lit(0.0)) * F.lit(FLOAT32_MAX)
    return F.when(x.isNotNull(), F.coalesce(F.when(high != low, bounded).otherwise(direction), F.lit(0.0)))


def scale_serve(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling as in serving: a zero range counts as 1, NaN passes through."""
    span = high - low
    return (x - low) / F.when(span == 0.0, F.lit(1.0)).otherwise(span)


def sensor_array(sensors) -> Column:
    """The sensor columns as one array of doubles, in the given order."""
    return F.expr(f"array({', '.join(f'CAST(`{s}` AS DOUBLE)' for s in sensors)})")


def row_mse(actual: Column, other: Column) -> Column:
    """Mean squared difference of two equally long arrays; NULL if the lengths differ."""
    squares = F.zip_with(actual, other, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(actual) == F.size(other), total / F.nullif(F.size(actual), F.lit(0)))
