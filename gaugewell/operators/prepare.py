"""Cleaning: imputation, null audit, projection to features, split by state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.scalar import fill_null, sensor_array
from gaugewell.operators.selection import exact_medians, join_same
from gaugewell.schema import BROKEN, MISSING, NORMAL, RECOVERING, SENSORS


# Fill values travel with the plan.
MOST_COLUMNS = 10_000


@dataclass(frozen=True)
class Imputer:
    """Fitted fill values: one median per numeric column, 0 where a column has no value."""

    medians: dict[str, float]

    @classmethod
    def fit(cls, rows: DataFrame) -> Imputer:
        numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
        # one record per column of the table
        found = exact_medians(rows, numeric).select("column", "median").collect()
        return cls({r["column"]: 0.0 if r["median"] is None else r["median"] for r in found})

    @classmethod
    def load(cls, saved: DataFrame) -> Imputer:
        """From one record per column; a table with more than ``MOST_COLUMNS`` or repeated columns is refused."""
        rows = saved.select("column", "median").limit(MOST_COLUMNS + 1).collect()
        medians = {r["column"]: r["median"] for r in rows}
        if len(rows) > MOST_COLUMNS or len(medians) != len(rows):
            raise ValueError(f"saved medians need one record per column and at most {MOST_COLUMNS}")
        return cls(medians)

    def save(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.medians.items()), "column string, median double")

    def transform(self, rows: DataFrame) -> DataFrame:
        """Fill every column in one projection; timestamps are left alone."""

        def filled(field: T.StructField):
            column = F.col(field.name)
            if field.name in self.medians:
                # a whole-number column turns fractional if its median is, as the fill value decides
                median = self.medians[field.name]
                whole = isinstance(field.dataType, T.IntegralType) and float(median).is_integer()
                return fill_null(column, F.lit(median).cast(field.dataType) if whole else median).alias(field.name)
            if isinstance(field.dataType, T.StringType):
                return fill_null(column, MISSING).alias(field.name)
            return column

        return rows.select(*[filled(f) for f in rows.schema.fields])


def impute_by(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Fill with the median of the row's own group instead of the whole table's."""
    medians = exact_medians(rows, columns, by)
    wide = medians.groupBy(*by).pivot("column", columns).agg(F.first("median"))
    wide = wide.select(*by, *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = join_same(rows, wide, by, "left")
    kept = [F.coalesce(c, f"_m_{c}", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return joined.select(*kept)


def _null_counts(columns: list[str]) -> list[Column]:
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    total = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).cast("long").alias("total_nulls")
    return [*counts, total]


def null_audit(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL count per column and in total, as one row from one aggregate."""
    return rows.agg(*_null_counts(columns or rows.columns))


def clean(rows: DataFrame, imputer: Imputer | None = None, path: str | None = None) -> DataFrame:
    """Impute and make sure nothing is left to fill; raises ValueError otherwise.

    With a ``path`` the result is stored there and read back, and the write itself
    counts the nulls; without one they are counted by a pass of their own.
    """
    filled = (imputer or Imputer.fit(rows)).transform(rows)
    if path is None:
        left = null_audit(filled).first().asDict()
    else:
        audit = Observation()
        filled.observe(audit, *_null_counts(filled.columns)).write.mode("overwrite").parquet(path)
        left, filled = audit.get, filled.sparkSession.read.schema(filled.schema).parquet(path)
    if left.get("total_nulls"):
        where = ", ".join(c for c in filled.columns if left[c])
        raise ValueError(f"{left['total_nulls']} null values are left after imputation: {where}")
    return filled


def features(rows: DataFrame, sensors: list[str] = SENSORS, name: str = "features") -> DataFrame:
    """Sensor columns as one array in sensor order; other columns stay beside it."""
    other = [c for c in rows.columns if c not in set(sensors)]
    return rows.select(*other, sensor_array(sensors).alias(name))


def by_status(rows: DataFrame, status: str = "machine_status") -> DataFrame:
    """The rows of the three known states, each tagged with its plot series."""
    series = (
        F.when(F.col(status) == NORMAL, "normal")
        .when(F.col(status) == BROKEN, "broken")
        .when(F.col(status) == RECOVERING, "recovering")
    )
    return rows.where(F.col(status).isin(NORMAL, BROKEN, RECOVERING)).withColumn("series", series)
