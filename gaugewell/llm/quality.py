"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measures of the text alone. Each is cut into bins at quantiles. The
model is a sum of look-up tables, one per feature and one per chosen pair of
features; cyclic boosting fits them: round by round, each feature in turn gets a
shallow tree on the gradient of the logistic loss, and the tree is added to its
table. Pairs are chosen by the gain that a tree over both would bring after the
single features are fitted. A document's score is the logistic function of the
sum of one entry of each table.

Spark measures and scores every document in one pass without a shuffle. The
model is fitted on the driver from at most ``SAMPLE`` labelled rows (the ones
whose ids hash lowest), so its input is bounded at some 4 MB; fewer rows are all
used.

Cases: a null text is measured as an empty one, and gets a score. Labels that
are null, or whose document is missing, are left out; a document labelled twice
counts twice. Without labels, or with one kind only, the score is the smoothed
share of good labels, the same for all. Repeated rows are scored one by one.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SAMPLE = 40_000
FEATURES = [
    "chars", "words", "word_length", "longest_word", "upper", "digits", "symbols", "marks_per_word", "sentence_ends",
    "commas", "beyond_ascii", "distinct_words", "distinct_pairs", "top_word", "same_neighbours", "lines", "distinct_lines",
    "distinct_bytes",
]


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGITS = _bytes("0123456789")
_ENDS, _COMMAS = _bytes(".?"), _bytes(",;:")
_SPACES = _bytes(" \t\r\n\v\f")
_ASCII = np.arange(256) < 128
_SYMBOLS = _ASCII & ~(_UPPER | _LOWER | _DIGITS | _SPACES | _ENDS | _COMMAS)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGITS, _ENDS, _COMMAS, _SYMBOLS, ~_ASCII, _SPACES]).astype(np.float64)


def measure(text: str | None) -> list[float]:
    """FEATURES of a text; all finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits, ends, commas, symbols, beyond, spaces = _CLASSES @ counts
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n, size = max(1, len(words)), max(1, len(raw))
    frequent = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - spaces) / n, np.log1p(max(map(len, frequent), default=0)),
        upper / max(1.0, upper + lower), digits / size, symbols / size, symbols / n, ends / n,
        commas / n, beyond / size, len(frequent) / n, pairs / max(1, len(words) - 1), max(frequent.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        float(np.count_nonzero(counts)),
    ]


def held_out(doc_id: Column) -> Column:
    """The rows that never teach; a null id has no label to teach."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# --- the model ---


def _split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int]:
    """Best cut of ordered bins in two: (gain, bins on the left)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: its value in each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b], smooth), a, b) for a, b in parts), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts = [p for p in parts if p != (a, b)] + [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + smooth)
    return out


def _corner_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts a grid once along each side: (gain, value in each cell)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quarters = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quarters.append((cg[-1, -1] - sum(q[0] for q in quarters), ch[-1, -1] - sum(q[1] for q in quarters)))
    gain = sum(x**2 / (y + smooth) for x, y in quarters) - cg[-1, -1] ** 2 / (ch[-1, -1] + smooth)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + smooth)
    return float(gain[i, j]), out


@dataclass
class Additive:
    """Look-up tables over binned features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # edges for the pairs
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @property
    def learned(self) -> bool:
        return bool(self.tables)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 300, rate: float = 0.1, pairs: int = 8, patience: int = 12) -> Additive:
    """Cyclic boosting; each sixth row only decides when to stop."""
    y = np.asarray(y, dtype=np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Additive(base=float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    smooth = 5.0
    check = np.arange(len(y)) % 6 == 5
    if not check.any():
        check[:] = True
    model.edges, model.coarse = _edges(x, bins), _edges(x, 12)
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    total = np.full(len(y), model.base)
    weight = np.ones(len(y)) if check.all() else (~check).astype(np.float64)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (y - p) * weight, p * (1 - p) * weight

    def boost(step, keep, back) -> None:
        """Runs ``step`` until the rows set aside stop gaining; goes back to the best round."""
        best, since = np.inf, 0
        kept = keep()
        for _ in range(rounds):
            step()
            loss = np.mean(np.logaddexp(0, np.where(y == 1, -total, total))[check])
            if loss < best - 1e-6:
                best, since, kept = loss, 0, keep()
            elif (since := since + 1) >= patience:
                break
        back(kept)

    def single() -> None:
        for j, at in enumerate(fine):
            g, h = gradient()
            n = len(model.edges[j]) + 1
            delta = rate * _tree(np.bincount(at, g, n), np.bincount(at, h, n), smooth)
            model.tables[j] += delta
            total[:] += delta[at]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = rough[i] * b + rough[j]
        return np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b)

    def double() -> None:
        for i, j, values in model.pairs:
            delta = rate * _corner_tree(*grid(i, j, *gradient()), smooth)[1]
            values += delta
            total[:] += delta[rough[i], rough[j]]

    def restore(kept: list[np.ndarray], tables: list[np.ndarray], at: list) -> None:
        for values, old, where in zip(tables, kept, at):
            total[:] += (old - values)[where]
            values[...] = old

    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    boost(single, lambda: [t.copy() for t in model.tables], lambda kept: restore(kept, model.tables, fine))
    wide = [j for j, e in enumerate(model.coarse) if len(e)]
    g, h = gradient()
    gains = sorted(((_corner_tree(*grid(i, j, g, h), smooth)[0], i, j) for k, i in enumerate(wide) for j in wide[k + 1 :]), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in gains[:pairs]]
    tables = [p[2] for p in model.pairs]
    boost(double, lambda: [t.copy() for t in tables], lambda kept: restore(kept, tables, [(rough[i], rough[j]) for i, j, _ in model.pairs]))
    return model


def _measured(texts: pd.Series) -> np.ndarray:
    return np.array([measure(t) for t in texts], dtype=np.float32).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Additive:
    """The model from those labelled rows that are not held out."""
    known = (
        labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(column).cast("double").alias("_label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label")
        .limit(sample)
    )
    # bounded by ``sample``
    texts = docs.select("doc_id", "text").join(F.broadcast(stored(known, "labelled")), "doc_id").select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _measured(batch.column(0).to_pylist())
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1)], ["f", "_label"])

    # repeated documents may make it more rows than labels: the bound holds for what comes back, too
    rows = texts.mapInArrow(run, "f array<float>, _label double").orderBy("f", "_label").limit(sample).toArrow()
    x = np.array(rows["f"].to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["_label"].to_numpy() > 0.5)


def scores(model: Additive) -> Callable[[Column], Column]:
    """The model as a function of a text column."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_measured(texts)))

    return lambda text: score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", scores(learn(docs, labels))(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rejected documents; a model that could not learn rejects none."""
    model = learn(docs, labels)
    return docs.filter(scores(model)(F.col("text")) >= threshold) if model.learned else docs
