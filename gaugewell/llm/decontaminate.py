"""Benchmark decontamination with a hash set of test n-grams, in DataFrame operations only.

Words are the runs of digits, a-z and characters beyond ASCII of the text with
A-Z lower-cased. A window is ``n`` consecutive words of an item; an item with
fewer words, but at least one, is one window. The windows of the documents are
looked up by hash and compared word by word where the hash is found.

Cases: a null text has no words, like an empty one. Documents are told apart by
(doc_id, text): rows that agree in both are judged alike and all returned, and
so are rows with a null doc_id. Items without an id count for hits, not for item
ids; repeated items count once. An empty benchmark leaves every document clean.
Only ``doc_id``/``text`` and ``item_id``/``text`` are read, so any other column
may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, repeated, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on lower-cased text
_NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # the same on the text as it is

# Bytes of windows, as rows in memory, that are sent to every executor. Those of
# larger benchmarks are joined by a shuffle on the hash.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _slice(at: str, n: Column) -> Column:
    return F.slice("words", F.greatest(F.col(at), F.lit(0)) + 1, n)


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """The distinct windows: (key, gram, n, items)."""
    size = F.size("words")
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        .filter(size > 0)
        .withColumn("n", F.least(F.lit(n), size))
        .select("item_id", "words", "n", F.explode(F.sequence(F.lit(0), size - F.col("n"))).alias("at"))
        .select("item_id", "n", _slice("at", F.col("n")).alias("gram"))
        .groupBy("gram", "n")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.xxhash64("gram").alias("key"), "gram", "n", "items")
    )


def _row_bytes() -> Column:
    """A window's size in memory: each string or number in words of eight bytes, and its place in an array."""
    strings = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + 24 + F.octet_length(s))
    return 64 + strings("gram") + strings("items")


def _keyed(docs: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """Of every document a head row (``at`` -1) and its windows: doc_id, text_key, words, n_words, at, len, at_key."""
    placed = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words")
    ).select(
        "doc_id", "text_key", "words", F.size("words").alias("n_words"),
        F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"),
    )
    if len(lengths) > 1:
        # the head row needs one length only
        each = F.when(F.col("at") < 0, F.array(F.lit(n))).otherwise(F.array(*map(F.lit, lengths)))
        placed = placed.select("*", F.explode(each).alias("len"))
    else:
        placed = placed.withColumn("len", F.lit(lengths[0]))
    whole = (F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("n_words"))
    return placed.withColumn("at_key", F.when(whole, F.xxhash64(_slice("at", F.col("len")))))


def _look_up(keyed: DataFrame, grams: DataFrame) -> DataFrame:
    """The hits where the windows of the items are at hand."""
    # The words are compared after the join: as a join key they would be copied for every window.
    return (
        keyed.join(F.broadcast(grams), F.col("at_key") == F.col("key"), "left")
        .filter((F.col("at") < 0) | (_slice("at", F.col("len")) == F.col("gram")))
        .select("doc_id", "text_key", "n_words", "at", F.coalesce("n", F.lit(1)).alias("n"), "items")
    )


def _look_up_far(docs: DataFrame, keyed: DataFrame, grams: DataFrame) -> DataFrame:
    """The same by shuffles: of a window only its place and hash travel, and texts only where a hash was found."""
    narrow = keyed.filter(F.col("at_key").isNotNull()).select("doc_id", "text_key", "at", "at_key")
    hit = F.struct("at", "n", "gram", "items")
    found = narrow.join(grams, F.col("at_key") == F.col("key")).groupBy("doc_id", "text_key").agg(F.collect_set(hit).alias("found"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.text_key") == F.col("f.text_key"))
    read = texts.alias("t").join(found.alias("f"), same).select("t.doc_id", "t.text_key", words(F.col("t.text")).alias("words"), "f.found")
    true = F.filter("found", lambda f: F.slice("words", f["at"] + 1, f["n"]) == f["gram"])
    rows = read.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(true).alias("hit"))
    hits_ = rows.select("doc_id", "text_key", "n_words", "hit.at", "hit.n", "hit.items")
    heads = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).alias("n_words"), F.lit(-1).alias("at"),
        F.lit(1).alias("n"), F.lit(None).cast("array<string>").alias("items"),
    )
    return heads.unionByName(hits_)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Of every document a head row (``at`` -1), and each of its windows that an item has.

    Columns: doc_id, text_key, n_words, at, n, items.
    """
    grams = stored(windows(benchmark, n), "windows")
    known = grams.groupBy("n").agg(F.sum(_row_bytes()).alias("bytes")).collect()  # a row for each length, n at most
    keyed = _keyed(docs, sorted(r["n"] for r in known) or [n], n)
    if sum(r["bytes"] for r in known) <= BROADCAST_BYTES:
        return _look_up(keyed, grams)
    return _look_up_far(docs, keyed, grams)


def covered(found: DataFrame) -> DataFrame:
    """``found`` with ``from``: words [from, at + n) are those no earlier hit of the document covers."""
    before = W.partitionBy("doc_id", "text_key").orderBy("at", "n").rowsBetween(W.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0))
    return found.withColumn("from", F.greatest("at", end))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    new = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.col("from"))
    per_doc = (
        covered(hits(docs, benchmark, n))
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum((F.col("at") < 0).cast("long")).alias("rows"),
            F.max("n_words").cast("long").alias("n_words"),
            F.sum(F.when(F.col("at") >= 0, new).otherwise(0)).cast("long").alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    return repeated(per_doc, "rows").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        (F.col("n_hit") > 0).alias("contaminated"), "text_key",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) without the hit words.

    A removed word takes the separators before it along. Columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    d = docs.alias("d")
    same = lambda side: F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.xxhash64("d.text") == F.col(f"{side}.text_key"))
    hit = hits(docs, benchmark, n).filter("at >= 0")
    if remove == "documents":
        return d.join(hit.select("doc_id", "text_key").distinct().alias("h"), same("h"), "left_anti")
    spans = (
        covered(hit)
        .filter(F.col("at") + F.col("n") > F.col("from"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("from", (F.col("at") + F.col("n")).alias("to"))).alias("spans"))
    )
    pieces = F.regexp_extract_all("d.text", F.lit(f"[{_NOT_WORD}]*[^{_NOT_WORD}]+"), F.lit(0))
    clean = F.filter(pieces, lambda p, i: ~F.exists("s.spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    cut = F.concat(F.array_join(clean, ""), F.regexp_extract("d.text", f"[{_NOT_WORD}]*\\z", 0))
    text = F.when(F.col("s.spans").isNotNull(), cut).otherwise(F.col("d.text"))
    joined = d.join(spans.alias("s"), same("s"), "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
