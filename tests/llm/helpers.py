"""Small tables with the awkward cases, for all text operators."""

from pyspark.sql import functions as F

SAME = "one two three four five six seven eight nine ten eleven\nalpha beta gamma delta epsilon zeta eta theta iota"
CLASH = ["words", "at", "n", "len", "key", "gram", "items", "fp", "row", "rest", "score", "f", "digest", "kind", "start", "end", "found", "text_key", "line", "gone", "n_gone", "_copy", "prompt"]
ROWS = [
    (1, None),
    (2, ""),
    (3, "  \n\t\n "),
    (4, " ".join(f"w{i % 997}" for i in range(30_000)) + "\n" + "x" * 5_000),
    (5, SAME),
    (6, SAME),
    (6, SAME),
    (None, SAME),
    (None, None),
    (7, "ÉCOLE Ünïcode Straße İstanbul ΣΑΣ 日本語 \U0001f600"),
    (8, "a"),
    (9, "token = \"abcdefghijkl123456\" mail a.b@c.example +1 (212) 555-0100"),
]


def edge_docs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def no_docs(spark):
    return edge_docs(spark).filter("false")
