"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles.

Text is lower-cased (A-Z), split into words at ASCII white space and shingled by
``k`` words; a bit of the fingerprint is set when it is set in over half of the
shingles' XXH64 values. Two fingerprints are linked when at most ``radius`` bits
differ, and documents that links join form one component.

Distinct fingerprints are compared, not documents, so a group of copies is one
row. Fingerprints within the radius agree on at least one of ``radius + 1``
bands of bits, so each band's value is a bucket and only rows of a bucket are
compared. A bucket that exceeds ``tile`` rows is cut into tiles of one
population count (a frequent count into several); each pair of tiles whose
counts differ by no more than the radius is one unit of work, an exclusive-or
with bit counts in numpy, and the other pairs are skipped: those fingerprints
differ in more bits than the radius. A unit reports a spanning forest of
its links, not the links themselves.

Cases: a null text has no words, like an empty one; its fingerprint is zero and
links like any other. A text with fewer words than ``k`` is one shingle. Every
row gets its own result; rows with one doc_id count as one document for
``component_id``. A null doc_id never names a component unless all its ids are
null. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

BITS = 64
TILE = 2048
_BLOCK = 256  # rows of a tile compared at once: at most _BLOCK x TILE pairs in memory
_CHUNK = 1 << 20


def fingerprint(text: str | None, k: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return h(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    values = np.array([h(joined[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), _CHUNK):
        ones += np.unpackbits(values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp, text_key) per row; fp is the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, fp long, text_key long")


def _bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands that cover all bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class _Forest:
    """Components among rows 0..n-1, merged from arrays of links; ``used`` are the links that merged two of them."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.used: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(root, high, low)
            won = np.nonzero(root[high] == low)[0]
            first = won[np.unique(high[won], return_index=True)[1]]
            self.used.append(np.stack([i[first], j[first]]))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one, as two arrays of fingerprints."""
    within = right is None
    values = left if within else np.concatenate([left, right])
    counts = np.bitwise_count(values)
    if within:
        order = np.argsort(counts, kind="stable")
        values, counts = values[order], counts[order]
    trees = _Forest(len(values))
    for at in range(0, len(left), _BLOCK):
        rows = values[at : at + _BLOCK]
        # within a tile, only rows after the block's first whose population count can still be near
        lo = at if within else len(left)
        hi = int(np.searchsorted(counts, int(counts[min(at + _BLOCK, len(left)) - 1]) + radius, "right")) if within else len(values)
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ values[None, lo:hi]) <= radius)
        trees.add(i + at, j + lo)
    i, j = np.concatenate(trees.used, axis=1)
    return values[i], values[j]


def _compare(radius: int):
    """Rows (band, value, lo, hi, side, fp) sorted by the first four -> links (a, b)."""

    def links(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = fp.view(np.uint64)
        return forest(values, None, radius) if not side.any() else forest(values[side == 0], values[side == 1], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the unit that may go on in the next batch
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(6)], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))[0] + 1
            bounds = [0, *cut.tolist()]
            held = [rows[bounds[-1] :]]
            yield from emit([rows[a:b] for a, b in zip(bounds, bounds[1:])])
        yield from emit(held)

    def emit(units: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [links(np.ascontiguousarray(u[:, 5]), u[:, 4]) for u in units if len(u) > 1]
        if found:
            a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join what the links within the radius join; ``fps``: distinct fp."""
    bands = F.array(*[
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1).alias("value"))
        for k, (first, bits) in enumerate(_bands(radius))
    ])
    rows = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(bands).alias("b")).select("fp", "ones", "b.band", "b.value")
    # at most (radius + 1) x 2^13 buckets for a radius of 4, of 65 counts each
    parts = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    plan = (
        parts.groupBy("band", "value")
        .agg(F.sum("n").alias("rows"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("parts"))).alias("tiles"))
        .filter(F.col("rows") > tile)
        .select("band", "value", F.map_from_entries("tiles").alias("parts"), "tiles")
    )
    code = lambda ones, part: ones * F.lit(1 << 24) + part
    mine = code(F.col("ones"), F.pmod(F.xxhash64("fp", "band"), F.col("parts")[F.col("ones")]).cast("int"))
    near = F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["parts"] - 1), lambda p: code(t["ones"], p))))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))
    pair = lambda o: F.struct(F.least("mine", o).alias("lo"), F.greatest("mine", o).alias("hi"), (F.col("mine") > o).cast("int").alias("side"))
    units = (
        rows.join(plan, ["band", "value"], "left")
        .withColumn("mine", F.when(F.col("parts").isNotNull(), mine))
        .select("band", "value", "fp", F.explode(F.when(F.col("parts").isNull(), one).otherwise(F.transform(others, pair))).alias("u"))
        .select("band", "value", "u.lo", "u.hi", "u.side", "fp")
    )
    key = ["band", "value", "lo", "hi"]
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(radius), "a long, b long")


def near_groups(docs: DataFrame, k: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, fp, text_key, root (one value for each component), component_id (the smallest doc_id reachable over links)."""
    rows = stored(fingerprints(docs, k), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fp")
    found = components(near_links(fps.select("fp"), radius, tile))
    known = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # `first` of a root's component; small groups and large ones alike are reduced before the shuffle
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(known.join(least, "root").select("fp", "root", "component_id"), "named_fp")
    return rows.join(named, "fp").select("doc_id", "fp", "text_key", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each component (``root``) the row that names it. Columns and texts stay as they are.

    Rows are told apart by doc_id and text: of rows with the smallest doc_id, the
    one with the smallest text key stays, and of rows that agree in both, any one.
    A component without any doc_id keeps one of its rows.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = groups.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct(rank.alias("rank"), "n")).alias("first"))
    first = stored(first.select("first.rank.doc_id", "first.rank.text_key", "first.n"), "kept_rows")
    d = docs.alias("d")
    same = (F.xxhash64("d.text") == F.col("k.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    single = d.join(first.filter("n = 1").alias("k"), same, "left_semi")
    several = first.filter("n > 1")
    if several.isEmpty():
        return single
    return single.unionByName(d.join(several.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
