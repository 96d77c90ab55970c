"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row per
distinct text: (digest, keep_id, batch). New data is reduced to its distinct
digests, those the index lacks are found by a sort-merge anti-join that moves
only the new side, and these are appended. A batch that is tried again finds its
own rows under its name, drops nothing new and gives the same result.

Cases: a null text counts as empty. Of equal texts the row with the largest
doc_id stays, a null doc_id being the smallest; a text that the index had before
keeps the index's row, and no new row of it stays. Of rows that agree in doc_id
and text exactly one stays. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


class DigestIndex:
    """The index at ``path``, a folder all executors share; created when it is missing.

    ``buckets`` is fixed at creation: some 200 MB of digests in each is a good
    size. ``name`` is the name in the session's catalog only, one for each path.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unbucketed(self) -> DataFrame:
        """The same rows, for joins with a side where one digest may be frequent:
        both sides are shuffled then, and a skewed partition can be split."""
        schema = "digest BINARY, keep_id " + dict(self.rows().dtypes)["keep_id"] + ", batch STRING"
        return self.spark.read.schema(schema).parquet(self.path)

    def append(self, found: DataFrame, batch: str) -> None:
        """Adds those of ``found`` (digest, keep_id; digests distinct) that the index lacks."""
        new = found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size (in this batch), kept, text_sha256."""
    rows = stored(digests(docs).groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index.append(groups.select("digest", "keep_id"), batch)
    # written, so that the next join has a shuffle on both sides and a frequent digest can be split
    decided = stored(groups.select("digest", "group_size").join(index.unbucketed(), "digest"), "decided")
    out = (
        rows.join(decided, "digest")
        .select(
            "doc_id", "keep_id", "group_size", "n",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("stays"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )
