"""Near-duplicates by SimHash, completed to all links of a shingle similarity.

Text is lower-cased (A-Z), split into words at ASCII white space and shingled by
``K`` words, as in ``simhash``. Two texts are linked when the Jaccard similarity
of their sets of distinct shingles (as XXH64 values) is 4/5 or more, and texts
that links join form one component.

First ``simhash`` compares the fingerprints of all texts in its tiles. Texts of
one fingerprint, and those of fingerprints ``RADIUS`` bits apart at most, are
candidates; what has the similarity is a link.

Similar texts may differ in more bits, so an exact join adds the links between
texts that are not joined yet. It misses none: if the shingles are put in any
fixed order, similar texts share one among the first fifth (and one) of each, so
only texts that share such a shingle are compared. The order is by hash, but
shingles of many texts come last, so a common passage brings few texts together. Pairs whose sizes or places of the shared shingle rule the similarity
out are skipped. So are pairs whose sketches do: a text's sketch holds, for each
of ``BITS`` classes of shingles, whether their number is odd, so texts whose
sketches differ in d bits differ in d shingles or more, and similar texts differ
in a ninth of their sizes' sum at most. All others are counted exactly.

Distinct texts are compared, not rows, so a group of copies is one text. A
shingle with over ``SMALL`` texts first links its texts to a few of them;
then only texts of different components are compared, so a large group of near
copies is not compared pair by pair.

Cases: a null text has no words, like an empty one, and is linked to all such.
A text with fewer words than ``K`` is one shingle. A null doc_id never names a
component unless all its ids are null. Columns besides doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import stored
from .components import components

K = 5
RADIUS = 4  # bits
FREQUENT = 10  # texts
COUNTED = 44
MOST_FREQUENT = 2_000_000  # shingles sent to every executor; with more, FREQUENT is doubled until they are fewer
SMALL = 32
CENTRES = 24
BITS = 512  # of a sketch
_WORDS = [f"b{i}" for i in range(BITS // 64)]
_AT_ONCE = 1 << 18  # pairs


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], dtype="<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[k - 1 :])], dtype="<u8"))


def leading(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - COUNTED)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles by the last bits of their hash."""
    odd = (np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> key and the words of the sketch."""
    for batch in batches:
        found = np.array([sketch(shingles(t.as_py())) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(_WORDS))
        words = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(_WORDS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *words], ["key", *_WORDS])


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _frequent(texts: DataFrame) -> np.ndarray:
    """Sorted leading bits of the shingles that come last in the order; they steer what is compared, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for text in batch.column(0):
                held.append(leading(shingles(text.as_py())))
                size += len(held[-1])
                if size > 1 << 20:
                    yield counted(held)
                    held, size = [], 0
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([*held, np.zeros(0, "<u8")]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, type=pa.int32())], ["token", "n"])

    counts = texts.select("text").mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    counts = stored(counts, "frequent_shingles")
    by_doubling = dict(counts.groupBy(F.floor(F.log2(F.col("n") / FREQUENT)).cast("int")).count().collect())
    step = next(k for k in range(65) if sum(n for j, n in by_doubling.items() if j >= k) <= MOST_FREQUENT)
    found = counts.filter(F.col("n") >= FREQUENT << step).select("token").toArrow().column(0)
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(frequent: np.ndarray):
    """(key, text) -> (token, key, n, pos) of the shingles that any similar text must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, key, n, pos = [], [], [], []

            def out() -> pa.RecordBatch:
                columns = [np.concatenate(token).view(np.int64), np.concatenate(key), np.concatenate(n), np.concatenate(pos)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "key", "n", "pos"])

            for i, (k, text) in enumerate(zip(batch.column(0), batch.column(1))):
                values = shingles(text.as_py())
                late = _in(frequent, leading(values))
                values = np.concatenate([values[~late], values[late]])
                size = len(values) - -(-4 * len(values) // 5) + 1
                token.append(values[:size])
                key.append(np.full(size, k.as_py(), dtype=np.int64))
                n.append(np.full(size, len(values), dtype=np.int32))
                pos.append(np.arange(size, dtype=np.int32))
                if i % 500 == 499:
                    yield out()
                    token, key, n, pos = [], [], [], []
            if token:
                yield out()

    return run


def _may_link(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, first: bool) -> np.ndarray:
    """Whether texts i and j can be similar, given the places of a shingle that they share; ``first``: the first one."""
    a, b, p, q = n[i][:, None], n[j][None, :], pos[i][:, None], pos[j][None, :]
    before = 0 if first else np.minimum(p, q)
    return 9 * (before + np.minimum(a - p, b - q)) >= 4 * (a + b)


def _near(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sketches of texts i and j allow them to be similar."""
    differing = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    return 9 * differing <= n[i] + n[j]


def _pairs(stars: bool):
    """Rows (token, key, n, pos, root, sketch) sorted by token -> pairs (a, b) of different roots; ``stars``: with the centres of large groups only."""

    def group(key, n, pos, root, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if stars:
            if len(key) <= SMALL:
                return
            mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            lefts = np.argsort(mixed, kind="stable")[:CENTRES]
        elif (root != root[0]).any():
            lefts = np.arange(len(key))
        else:
            return
        block = max(1, _AT_ONCE // len(key))
        for at in range(0, len(lefts), block):
            left = lefts[at : at + block]
            right = np.arange(0 if stars else at, len(key))
            i, j = np.nonzero(_may_link(n, pos, left, right, not stars) & (root[left][:, None] != root[right][None, :]))
            i, j = left[i], right[j]
            near = _near(n, bits, i, j)
            yield key[i[near]], key[j[near]]

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], np.nonzero(rows[1:, 0] != rows[:-1, 0])[0] + 1, [len(rows)]])
        found, size = [], 0
        for a, b in zip(bounds, bounds[1:]):
            of_token = [np.ascontiguousarray(rows[a:b, c]) for c in range(1, 5)]
            for pair in group(*of_token, rows[a:b, 5:].view(np.uint64)):
                found.append(np.sort(np.stack(pair, axis=1), axis=1))
                size += len(found[-1])
                if size > 100_000:
                    yield batch_of(found)
                    found, size = [], 0
        if size:
            yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the token that may go on in the next batch
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(batch.num_columns)], axis=1)
            if not len(rows):
                continue
            if held and held[-1][-1, 0] == rows[0, 0] == rows[-1, 0]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = [rows[last:]]
            yield from emit(rows[:last]) if last else ()
        if held:
            yield from emit(np.concatenate(held))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> the pairs (a, b) that are similar."""
    last, left = None, None
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            if (a := batch.column(0)[i].as_py()) != last:
                last, left = a, shingles(batch.column(2)[i].as_py())
            if similar(left, shingles(batch.column(3)[i].as_py())):
                keep.append(i)
        at = pa.array(keep, type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar."""
    side: Callable[[str], DataFrame] = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verify, "a long, b long"), "near_links")


def simhash_links(texts: DataFrame, radius: int = RADIUS, tile: int = simhash.TILE) -> DataFrame:
    """Links (a, b) that SimHash finds among distinct texts (key, text), each counted exactly.

    A large group of texts with one fingerprint is linked to its first text, and
    fingerprints by a spanning forest of their links, not pair by pair.
    """
    rows = stored(simhash.fingerprints(texts.withColumnRenamed("key", "doc_id"), K).select(F.col("doc_id").alias("key"), "fp"), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct_fp")
    same = rows.join(fps, "fp").filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    first: Callable[[str], DataFrame] = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = simhash.near_links(fps.select("fp"), radius, tile).distinct().join(first("a"), "a").join(first("b"), "b")
    pairs = same.union(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))).distinct()
    return _verified(stored(pairs, "simhash_pairs"), texts)


def _links(shared: DataFrame, texts: DataFrame, sketches: DataFrame, roots: DataFrame, stars: bool) -> DataFrame:
    rows = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = rows.join(sketches, "key").select("token", "key", "n", "pos", "root", *_WORDS).repartition("token").sortWithinPartitions("token")
    return _verified(stored(rows.mapInArrow(_pairs(stars), "a long, b long").distinct(), "near_pairs"), texts)


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, root (one value for each component), component_id (the component's smallest doc_id)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    texts = stored(docs.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")), "texts")
    prefixes = texts.mapInArrow(_prefixes(_frequent(texts)), "token long, key long, n int, pos int")
    several = prefixes.withColumn("texts", F.count("*").over(Window.partitionBy("token"))).filter("texts > 1")
    shared = stored(several.drop("texts"), "shared_shingles")
    sketches = stored(texts.select("key", "text").mapInArrow(_sketches, ", ".join(f"{c} long" for c in ["key", *_WORDS])), "sketches")
    links = simhash_links(texts)
    for stars in (True, False):
        links = links.union(_links(shared, texts, sketches, components(links), stars))
    roots = components(links)
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    named = firsts.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").select("text_key", "first", F.coalesce("root", "text_key").alias("root"))
    named = stored(named, "named_texts")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stored(named.join(least, "root").select("text_key", "root", "component_id"), "near_roots")
    return rows.join(found, "text_key").select("doc_id", "text_key", "root", "component_id")
