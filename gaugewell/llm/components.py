"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum."""
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, undirected); root is the smallest node.

    Large-star and small-star in turn: every node links its larger, then its
    smaller neighbours to the smallest one it knows, until nothing changes. Each
    round is written to the shared folder. A node's neighbours are only ever
    reduced to their minimum, so a node with very many of them is no large group.
    Self-loops and repeated edges change nothing; without edges there are no rows.
    """
    links = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(links(edges), "links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(links(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = stored(links(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))), "links")
        state, before = _state(now), state
        if state == before:
            # no star changes any more: each node has one edge, to its root
            break
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
