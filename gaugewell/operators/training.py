"""Training the autoencoder with one Spark job per epoch.

Rows are dealt to slices by a hash of their id. Each slice runs Adam on
mini-batches of its own rows, starting from the same parameters and moments;
after the epoch these are averaged, weighted by the rows of each slice (parallel
SGD with parameter averaging, Zinkevich et al. 2010). With one slice this is
plain Adam. Slices, and the order of a slice's rows in an epoch, are functions
of seed, epoch and id, so the outcome does not depend on how rows lie in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.scalar import sensor_array
from gaugewell.operators.autoencoder import WIDTHS, Weights, scale_rows
from gaugewell.operators.scaler import Scaler
from gaugewell.schema import SENSORS

# The optimiser settings of the training job.
LEARNING_RATE = 0.001
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
MINI_BATCH = 50
PATIENCE = 5


@dataclass(frozen=True)
class TrainedModel:
    weights: Weights
    scaler: Scaler
    losses: tuple[float, ...]
    stopped_early: bool


def stop_epoch(losses: Iterable[float], patience: int = PATIENCE) -> int | None:
    """The first epoch, from 1, after which ``patience`` epochs brought no strictly smaller loss."""
    best, stale = float("inf"), 0
    for epoch, loss in enumerate(losses, 1):
        best, stale = (loss, 0) if loss < best else (best, stale + 1)
        if stale >= patience:
            return epoch
    return None


def stop_epochs(losses: Column, patience: int = PATIENCE) -> Column:
    """``stop_epoch`` of an array of losses."""
    return F.pandas_udf(lambda lists: lists.map(lambda one: stop_epoch(one, patience)).astype("Int32"), "int")(losses)


def _pack(arrays) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _unpack(flat: np.ndarray, shapes) -> list[np.ndarray]:
    out, at = [], 0
    for rows, cols in shapes:
        out.append(flat[at : at + rows * cols].reshape(rows, cols))
        at += rows * cols
    return out


def loss_and_gradient(layers: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean squared reconstruction error of a mini-batch and its gradient per layer."""
    values = Weights(tuple(layers)).activations(x)
    difference = values[-1] - x
    upstream = 2.0 * difference / difference.size
    gradient: list[np.ndarray] = [None] * len(layers)
    for i in range(len(layers) - 1, -1, -1):
        gradient[i] = np.vstack([values[i].T @ upstream, upstream.sum(axis=0)])
        if i:
            upstream = (upstream @ layers[i][:-1].T) * (values[i] > 0.0)
    return float(np.mean(difference**2)), gradient


def _adam(flat, first, second, gradient, step):
    first = BETA1 * first + (1.0 - BETA1) * gradient
    second = BETA2 * second + (1.0 - BETA2) * gradient**2
    rate = LEARNING_RATE * np.sqrt(1.0 - BETA2**step) / (1.0 - BETA1**step)
    flat = flat - rate * first / (np.sqrt(second) + EPSILON * np.sqrt(1.0 - BETA2**step))
    return flat, first, second


_RESULT = "position int, total double, first double, second double, weight double, batches double, loss double"


def slice_of(tie: str, slices: int, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(tie).cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slices)).cast("int")


def epoch_order(tie: str, seed: int, epoch: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(tie).cast("string")))


def _run_epoch(data: DataFrame, scaler: Scaler, flat, first, second, steps: int, shapes, epoch: int, seed: int):
    spark = data.sparkSession
    state = spark.sparkContext.broadcast((flat, first, second))
    size = len(flat)
    low, high = np.array(scaler.low, dtype=float), np.array(scaler.high, dtype=float)

    def mini_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(slice, rows); the last of a slice may be short."""
        now, rest = None, None
        for batch in batches:
            if not len(batch):
                continue
            slices = batch.column(1).to_numpy()
            x = scale_rows(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), low, high, "train")
            cuts = np.flatnonzero(np.diff(slices)) + 1
            for which, part in zip(slices[np.append(0, cuts)], np.split(x, cuts)):
                if which == now:
                    part = np.vstack([rest, part])
                elif rest is not None and len(rest):
                    yield now, rest
                full = len(part) - len(part) % MINI_BATCH
                for at in range(0, full, MINI_BATCH):
                    yield which, part[at : at + MINI_BATCH]
                now, rest = which, part[full:]
        if rest is not None and len(rest):
            yield now, rest

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(mini_batches(batches), key=lambda pair: pair[0]):
            w, m, v = (a.copy() for a in state.value)
            seen, loss_sum, count = 0, 0.0, 0
            for _, x in own:
                count += 1
                loss, gradient = loss_and_gradient(_unpack(w, shapes), x)
                w, m, v = _adam(w, m, v, _pack(gradient), steps + count)
                seen, loss_sum = seen + len(x), loss_sum + loss
            batch_count, batch_loss = np.zeros(size), np.zeros(size)
            batch_count[0], batch_loss[0] = count, loss_sum
            at = np.arange(size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (at, w * seen, m * seen, v * seen, np.full(size, float(seen)), batch_count, batch_loss)],
                names=["position", "total", "first", "second", "weight", "batches", "loss"],
            )

    ordered = data.sortWithinPartitions("slice", epoch_order("tie", seed, epoch)).select("x", "slice")
    # the slices' parameters are averaged by Spark; one record per parameter comes back
    averaged = (
        ordered.mapInArrow(learn, _RESULT)
        .groupBy("position")
        .agg(
            (F.sum("total") / F.sum("weight")).alias("w"),
            (F.sum("first") / F.sum("weight")).alias("m"),
            (F.sum("second") / F.sum("weight")).alias("v"),
            F.sum("batches").alias("batches"),
            F.max("batches").alias("most"),
            F.sum("loss").alias("loss"),
        )
        .collect()
    )
    state.unpersist()
    if not averaged:
        raise ValueError("no rows to train on")
    averaged.sort(key=lambda r: r["position"])
    w, m, v = (np.array([r[c] for r in averaged]) for c in ("w", "m", "v"))
    head = averaged[0]
    return w, m, v, steps + int(head["most"]), head["loss"] / head["batches"]


def train_autoencoder(
    rows: DataFrame,
    sensors: list[str] = SENSORS,
    tie: str = "id",
    epochs: int = 25,
    patience: int = PATIENCE,
    partitions: int | None = None,
    seed: int = 42,
    start: Weights | None = None,
) -> TrainedModel:
    """Fit the scaler and the autoencoder; the last epoch's weights are kept.

    ``partitions`` is the number of slices, one a task (default: that of a shuffle).
    Rows are shuffled to them once; each epoch sorts a slice anew, which may spill.
    Rows that share an id follow each other in any order. ``start`` replaces the
    random first weights.
    """
    scaler = Scaler.fit(rows, sensors)
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.select(sensor_array(sensors).alias("x"), F.col(tie).alias("tie"), slice_of(tie, partitions, seed).alias("slice"))
    data = sliced.repartitionById(partitions, "slice").persist()
    try:
        weights = start or Weights.initial((len(sensors), *WIDTHS[1:-1], len(sensors)), seed)
        shapes = [layer.shape for layer in weights.layers]
        w = _pack(weights.layers)
        m, v, steps = np.zeros_like(w), np.zeros_like(w), 0
        losses: list[float] = []
        for epoch in range(epochs):
            w, m, v, steps, loss = _run_epoch(data, scaler, w, m, v, steps, shapes, epoch, seed)
            losses.append(loss)
            if stop_epoch(losses, patience):
                break
    finally:
        data.unpersist()
    return TrainedModel(Weights(tuple(_unpack(w, shapes))), scaler, tuple(losses), stop_epoch(losses, patience) is not None)


def full_batch_step(rows: DataFrame, weights: Weights, scaler: Scaler, sensors: list[str] = SENSORS) -> tuple[Weights, float]:
    """One first Adam step on the mean loss of all rows, and that loss.

    The gradient is summed by Spark: each Arrow batch adds its own, and one record
    per parameter comes back.
    """
    layers = list(weights.layers)
    shapes = [layer.shape for layer in layers]
    low, high = np.array(scaler.low, dtype=float), np.array(scaler.high, dtype=float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, seen = 0.0, 0.0, 0
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            x = scale_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), low, high, "train")
            mine, gradient = loss_and_gradient(layers, x)
            total, loss, seen = total + _pack(gradient) * len(x), loss + mine * len(x), seen + len(x)
        if seen:
            # the loss rides along as a last position
            values = np.append(total, loss)
            at = np.arange(len(values), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values), pa.array(np.full(len(values), seen))], ["position", "total", "seen"])

    sums = rows.select(sensor_array(sensors).alias("x")).mapInArrow(add, "position int, total double, seen long")
    mean = sums.groupBy("position").agg((F.sum("total") / F.sum("seen")).alias("g")).orderBy("position").collect()
    if not mean:
        raise ValueError("no rows to train on")
    gradient = np.array([r["g"] for r in mean])
    flat = _pack(layers)
    flat, _, _ = _adam(flat, np.zeros_like(flat), np.zeros_like(flat), gradient[:-1], 1)
    return Weights(tuple(_unpack(flat, shapes))), float(gradient[-1])
