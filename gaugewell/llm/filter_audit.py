"""Audit of filters that run one after another, for every order of them.

A document's set of failed filters (its mask) decides, for each of the 120 orders
of five filters, at which step it goes. Orders are ranked lexicographically (by
their Lehmer code), so all orders that begin alike are one interval of ranks: a
prefix of k letters covers (5 - k)! of them. A mask is removed at step k by just
those prefixes of k letters whose last letter is in the mask and whose others
are not. So documents are counted by part and mask once; each count is added
where such an interval begins and taken off where it ends, and a running sum over
the 120 ranks gives what every order removes at every step.

Documents are read once. What is grouped later has at most 32 rows a part, and
nothing depends on the number of documents but those counts. Repeated texts are
found by the smallest doc_id of each SHA-256, and only texts that occur more than
once are joined back.

Filters: A, too few words; B, too few distinct words; C, too many capitals (A-Z);
D, a special character; E, a text that a smaller doc_id has too, whether that one
is removed or not.

Cases: a null text is an empty one: it fails A, and E if it is repeated. A null
doc_id is neither smaller nor larger than another, so such a row never fails E
nor makes others fail it, and has no label. Rows with one doc_id don't make each
other fail E. Repeated rows count as often as they occur. Of several labels of
one doc_id any 1 counts. A null part counts with the empty string. Without
documents there are no parts and no rows. Columns besides doc_id, text, the part
and the labels' doc_id, quality and toxic are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
_SPECIAL = re.compile(rb"[#$%&*|]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Limits:
    words: int = 100
    distinct_percent: int = 80
    capitals_percent: int = 10


def fails(text: str, limits: Limits = Limits()) -> int:
    """The mask of A to D: bit i is set if the i-th filter fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the six ASCII white-space characters
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    failed = (
        len(words) < limits.words,
        100 * len(set(words)) < limits.distinct_percent * len(words),
        100 * capitals > limits.capitals_percent * len(text),
        _SPECIAL.search(raw) is not None,
    )
    return sum(bit << i for i, bit in enumerate(failed))


def masks(docs: DataFrame, part: str, limits: Limits = Limits()) -> DataFrame:
    """Per document: doc_id, part, mask of A to E."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.zeros(batch.num_rows, dtype=np.int32)
            digest = []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                mask[i] = fails(text, limits)
                digest.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
            columns = [batch.column(0), batch.column(1), pa.array(mask), pa.array(digest, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "digest"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "text")
    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    # written, so that both sides of the join are shuffled and a frequent text can be split
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1").select("digest", "first"), "first_of_text")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + again * 16).alias("mask"))


def counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: n, good, toxic (documents); at most 32 rows a part."""
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return found.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def removal_intervals() -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove the mask at the step."""
    size = len(FILTERS)
    for mask in range(1, 1 << size):
        for step in range(1, size + 1):
            for prefix in itertools.permutations(range(size), step):
                if mask >> prefix[-1] & 1 and not any(mask >> f & 1 for f in prefix[:-1]):
                    # Lehmer code: how many letters that are still free stand before each one
                    rank = sum(
                        sum(g < f and g not in prefix[:i] for g in range(size)) * math.factorial(size - 1 - i) for i, f in enumerate(prefix)
                    )
                    yield mask, step, rank, rank + math.factorial(size - step)


def _orders(spark: SparkSession) -> DataFrame:
    """The 600 rows (rank, filter_order, step, bit of the filter at that step)."""
    rows = [
        (rank, "".join(order), step + 1, FILTERS.index(f))
        for rank, order in enumerate(itertools.permutations(FILTERS))
        for step, f in enumerate(order)
    ]
    return F.broadcast(spark.createDataFrame(rows, "rank int, filter_order string, step int, bit int"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    by_mask = stored(counts(masks(docs, part, limits), labels), "mask_counts")
    values = ["n", "good", "toxic"]
    intervals = F.broadcast(spark.createDataFrame(list(removal_intervals()), "mask int, step int, begin int, end int"))
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    changes = (
        by_mask.join(intervals, "mask")
        .select("part", "step", *values, ends.alias("e"))
        .groupBy("part", "step", F.col("e.rank").alias("rank"))
        .agg(*[F.sum(F.col(v) * F.col("e.sign")).alias(v) for v in values])
    )
    filters = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(1 << i).alias("alone")) for i in range(len(FILTERS))]))
    per_filter = by_mask.select("part", "mask", "n", filters.alias("f")).select("part", "mask", "n", "f.*").groupBy("part", "bit").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("alone")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("alone"), F.col("n")).otherwise(0)).alias("unique_fails"),
    )
    # every window below has 5 x 120 rows
    along = Window.partitionBy("part", "step").orderBy("rank")
    grid = per_filter.join(_orders(spark), "bit").join(changes, ["part", "step", "rank"], "left")
    lost = [F.coalesce(F.sum(v).over(along), F.lit(0)).alias(name) for v, name in zip(values, ("removed", "good_lost", "toxic_lost"))]
    removed = grid.select("part", "filter_order", "rank", "step", "bit", "documents", "fails", "unique_fails", *lost)
    before = Window.partitionBy("part", "rank").orderBy("step")
    return removed.select(
        "part", "filter_order", "step",
        (F.col("documents") - F.sum("removed").over(before)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"),
    )
