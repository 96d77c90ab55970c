"""Documents to packed training sequences, in five stages.

``STAGES`` are applied in order, each result being written and read again before
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import decontaminate, line_dedup, near_dedup, packing, quality, simhash
from gaugewell.llm.common import stored, table
from gaugewell.llm.encoding import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has go; so does a document of which nothing is left."""
    rest = line_dedup.drop_common_lines(docs, keep_empty=False)
    return rest.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 4/5 join, in shingles of five words, one stays.

    SimHash fingerprints in tiles bring up the links; an exact join adds those that differ in more bits.
    """
    return simhash.keep_one(docs, near_dedup.near_groups(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", remove_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", remove_benchmark),
    ("pack", pack),
]

# A model, an alignment and token ids: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
