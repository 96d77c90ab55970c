"""Helpers that several of the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **partitioning: int) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    It cuts the lineage, so that a lost executor costs its own tasks only, and a
    frame that is used several times is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, and no other letter.

    ``lower`` is much cheaper than ``translate`` and does the same wherever the
    text has no other letter with a lower case.
    """
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as column ``times`` says; the column goes."""
    columns = [c for c in df.columns if c != times]
    return df.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias("_copy")).select(*columns)


def spans_text(found: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(found: Column | str, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
