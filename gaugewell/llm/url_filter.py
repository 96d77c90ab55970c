"""URL filter against block lists as they were when a page was fetched.

List entries are dated: (entry, day, listed), where ``entry`` is a host name,
which covers its subdomains, or a whole URL. An entry's events become validity
intervals [from, to), and each capture is joined as of its fetch day with the
intervals of its URL, its host and the host's parents. An entry's intervals are
disjoint, so a capture meets each of its keys at most once, and there are no
more keys than labels in the host and one.

Cases: on one day, removal wins over listing; repeated events count once; events
without entry or day are left out. A removal without a listing before has no
effect, nor has a listing of what is listed. A capture without URL or without
fetch day is never blocked, and a URL without host only by its whole text. Every
capture row gets its own result, repeated rows too. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"\.$", ""))


def plain_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def keys(url: Column, name: str = "host") -> Column:
    """What an entry can say to cover the URL: it, its host, and the host's parents."""
    labels = F.split(F.col(name), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.col(name) == "", F.array(plain_url(url))).otherwise(F.concat(F.array(plain_url(url)), parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, from, to): the days on which an entry is listed; ``to`` is null while it still is."""
    by_day = (
        entries.filter("entry IS NOT NULL AND day IS NOT NULL")
        .groupBy("entry", "day")  # at most one row a day and entry goes on
        .agg(F.min(F.coalesce(F.col("listed"), F.lit(False))).alias("listed"))
    )
    order = W.partitionBy("entry").orderBy("day")
    changes = by_day.withColumn("before", F.coalesce(F.lag("listed").over(order), F.lit(False))).filter("listed <> before")
    return changes.withColumn("to", F.lead("day").over(order)).filter("listed").select("entry", F.col("day").alias("from"), "to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture: page_id, url, host, fetched, blocked, entry (the longest that blocks), listed_from, n_entries."""
    rows = stored(
        captures.select("page_id", "url", "fetched", F.coalesce(host(F.col("url")), F.lit("")).alias("host")).withColumn("row", F.monotonically_increasing_id()),
        "captures",
    )
    known = stored(intervals(entries), "intervals")
    asked = rows.filter("url IS NOT NULL").select("row", "fetched", F.explode(keys(F.col("url"))).alias("entry"))
    active = (F.col("fetched") >= F.col("from")) & (F.col("to").isNull() | (F.col("fetched") < F.col("to")))
    met = (
        asked.join(known, "entry")
        .filter(active)
        .groupBy("row")
        .agg(F.max(F.struct(F.length("entry").alias("size"), "entry", "from")).alias("best"), F.count("*").alias("n"))
    )
    return rows.join(met, "row", "left").select(
        "page_id", "url", "host", "fetched", F.col("best").isNotNull().alias("blocked"), F.col("best.entry").alias("entry"),
        F.col("best.from").alias("listed_from"), F.coalesce("n", F.lit(0)).alias("n_entries"),
    )
