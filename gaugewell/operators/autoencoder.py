"""Autoencoder weights and scoring by reconstruction error."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gaugewell.functions.scalar import FLOAT32_MAX
from gaugewell.operators.scaler import Scaler
from gaugewell.schema import WEIGHTS_SCHEMA

# Layer widths; ReLU follows every layer but the last.
WIDTHS = (52, 24, 12, 24, 52)
_MAX_VALUES = 1_000_000


@dataclass(frozen=True)
class Weights:
    """One (inputs + 1) x outputs matrix per layer; the last row is the bias."""

    layers: tuple[np.ndarray, ...]

    @classmethod
    def initial(cls, widths: tuple[int, ...] = WIDTHS, seed: int = 42) -> Weights:
        """Uniform in +-1/sqrt(inputs), the usual start of a linear layer."""
        rng = np.random.default_rng(seed)
        return cls(
            tuple(
                rng.uniform(-1.0, 1.0, (fan_in + 1, fan_out)) / np.sqrt(fan_in)
                for fan_in, fan_out in zip(widths, widths[1:])
            )
        )

    @classmethod
    def from_table(cls, table: DataFrame, version: str) -> Weights:
        """Read one version. A model is a fixed few thousand values; more is refused."""
        rows = table.where(F.col("version") == version).select("layer", "row", "col", "value").limit(_MAX_VALUES + 1).collect()
        if not rows or len(rows) > _MAX_VALUES:
            raise ValueError(f"model {version!r}: expected 1 to {_MAX_VALUES} weights, found {len(rows)}")
        layers = []
        for layer in range(max(r["layer"] for r in rows) + 1):
            mine = [r for r in rows if r["layer"] == layer]
            matrix = np.zeros((max(r["row"] for r in mine) + 1, max(r["col"] for r in mine) + 1))
            for r in mine:
                matrix[r["row"], r["col"]] = r["value"]
            layers.append(matrix)
        return cls(tuple(layers))

    def to_table(self, spark: SparkSession, version: str) -> DataFrame:
        values = [
            (version, layer, row, col, float(matrix[row, col]))
            for layer, matrix in enumerate(self.layers)
            for row in range(matrix.shape[0])
            for col in range(matrix.shape[1])
        ]
        return spark.createDataFrame(values, WEIGHTS_SCHEMA)

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """Input, hidden and output values of a batch of rows."""
        values = [x]
        for i, matrix in enumerate(self.layers):
            x = x @ matrix[:-1] + matrix[-1]
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
            values.append(x)
        return values


def scale_rows(x: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """The scaling rules of ``scale_train`` and ``scale_serve`` on a matrix of rows."""
    span = high - low
    if rule == "serve":
        return (x - low) / np.where(span == 0.0, 1.0, span)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((x - low) / span, nan=0.0, posinf=FLOAT32_MAX, neginf=-FLOAT32_MAX)


def reconstruction_error(
    features: Column, weights: Weights, scaler: Scaler, rule: str = "serve", on_error: str = "reject"
) -> Column:
    """Scale, run the autoencoder and average the squared difference, per row.

    ``features`` is an array column; batches travel as Arrow and are scored with
    one matrix product per layer. Rows of another width or with NULLs inside
    cannot be scored: ``on_error="reject"`` gives them NULL, ``"zero"`` 0.0.
    """
    if on_error not in ("reject", "zero"):
        raise ValueError("on_error is 'reject' or 'zero'")
    layers = weights.layers
    low, high = np.array(scaler.low, dtype=float), np.array(scaler.high, dtype=float)
    width = len(low)

    @arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(rows), width), False)
        usable = fits.to_numpy(zero_copy_only=False).copy()
        values = rows.filter(fits).flatten()
        gaps = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        x = values.to_numpy(zero_copy_only=False).reshape(-1, width)
        usable[usable] = ~gaps
        scaled = scale_rows(x[~gaps], low, high, rule)
        out = np.zeros(len(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            out[usable] = np.mean((Weights(layers).activations(scaled)[-1] - scaled) ** 2, axis=1)
        return pa.array(out, mask=None if on_error == "zero" else ~usable)

    # Filters on the score must not be pushed below it: they would carry a second
    # copy of the call, and of the whole array expression, into the plan.
    return score.asNondeterministic()(features.cast("array<double>"))


def score(
    rows: DataFrame,
    weights: Weights,
    scaler: Scaler,
    features: str = "features",
    rule: str = "serve",
    on_error: str = "reject",
    name: str = "reconstruction_error",
) -> DataFrame:
    """Add the reconstruction error; it is computed in the reading's own row, so nothing has to be matched up."""
    return rows.withColumn(name, reconstruction_error(F.col(features), weights, scaler, rule, on_error))
