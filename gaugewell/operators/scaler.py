"""Min-max statistics: fit, keep, apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.scalar import scale_serve, scale_train
from gaugewell.operators.selection import join_same
from gaugewell.schema import SCALER_SCHEMA, SENSORS


# A scaler travels with every task; a table with more sensors is refused.
MOST_SENSORS = 10_000

RULES = {"train": scale_train, "serve": scale_serve}


def _ranges(rows: DataFrame, sensors: list[str], by: list[str]) -> DataFrame:
    """Columns ``low_<sensor>`` and ``high_<sensor>`` from one aggregate; NaN counts as missing."""
    # one expression text per sensor; building them from parts costs a call per part
    number = {s: f"nanvl(CAST(`{s}` AS DOUBLE), CAST(NULL AS DOUBLE))" for s in sensors}
    lows = [F.expr(f"min({number[s]}) AS `low_{s}`") for s in sensors]
    return rows.groupBy(*by).agg(*lows, *[F.expr(f"max({number[s]}) AS `high_{s}`") for s in sensors])


def scaler_statistics(rows: DataFrame, sensors: list[str] = SENSORS, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest value per sensor, one record per sensor (and group)."""
    by = by or []
    records = [
        F.struct(F.lit(i).alias("sensor_idx"), F.col(f"low_{s}").alias("min"), F.col(f"high_{s}").alias("max"))
        for i, s in enumerate(sensors)
    ]
    return _ranges(rows, sensors, by).select(*by, F.inline(F.array(*records)))


@dataclass(frozen=True)
class Scaler:
    """Fitted statistics in sensor order."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def from_table(cls, statistics: DataFrame) -> Scaler:
        """From one record per sensor, numbered from 0; anything else is an error."""
        rows = sorted(statistics.select("sensor_idx", "min", "max").limit(MOST_SENSORS + 1).collect())
        if len(rows) > MOST_SENSORS or [r["sensor_idx"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"statistics need one record per sensor, numbered from 0, and at most {MOST_SENSORS}")
        return cls(tuple(r["min"] for r in rows), tuple(r["max"] for r in rows))

    @classmethod
    def fit(cls, rows: DataFrame, sensors: list[str] = SENSORS) -> Scaler:
        found = _ranges(rows, sensors, []).first()
        return cls(tuple(found[f"low_{s}"] for s in sensors), tuple(found[f"high_{s}"] for s in sensors))

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, lo, hi) for i, (lo, hi) in enumerate(zip(self.low, self.high))], SCALER_SCHEMA
        )

    def columns(self, sensors: list[str], rule: str):
        scale = RULES[rule]
        return [
            scale(F.col(s).cast("double"), F.lit(lo), F.lit(hi)).alias(s)
            for s, lo, hi in zip(sensors, self.low, self.high, strict=True)
        ]

    def transform(self, rows: DataFrame, sensors: list[str] = SENSORS, rule: str = "train") -> DataFrame:
        """Scale the sensor columns in place, all in one projection."""
        scaled = dict(zip(sensors, self.columns(sensors, rule)))
        return rows.select(*[scaled.get(c, F.col(c)) for c in rows.columns])


def scale_by(rows: DataFrame, sensors: list[str], by: list[str], rule: str = "train") -> DataFrame:
    """Scale with the statistics of the row's own group."""
    joined = join_same(rows, _ranges(rows, sensors, by), by, "left")
    scaled = {s: RULES[rule](F.col(s), F.col(f"low_{s}"), F.col(f"high_{s}")).alias(s) for s in sensors}
    return joined.select(*[scaled.get(c, F.col(c)) for c in rows.columns])
