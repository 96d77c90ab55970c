"""Personal data: base patterns, and identifiers found by bootstrapping contexts.

One pass over the texts gives each row's base spans and its candidates: tokens
with a digit or an at sign that no base span touches. Both carry their lexical
pattern (the two words before, lower-cased) and their instance (the characters
without separators, hashed). Base spans are the seeds.

Patterns and instances form a graph with an edge for each pair that occurs. Spark
scores it in rounds: a pattern's confidence for a kind is the mean score of its
instances, lowered for few instances; an instance that is no seed gets the mean
confidence of its patterns. After the last round, patterns whose confidence for
a kind reaches ``confidence`` and that have at least ``support`` seed instances
of it or instances scored through other patterns are accepted, and candidates
after them become spans of that kind if their form fits it.

Cases: a null text counts as empty. Offsets are code points, end exclusive. Each
row gets its own result, also repeated rows and rows without doc_id; repeated
texts count once as instances. Other columns are not read. Without seeds or
candidates only base spans are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. The email's is anchored at its @, from where the
# part before is read backwards; a search from every letter would be slow.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*")
_EDGES = "\"'()[]{}<>,;:!?.#&$*%|"
_CONTEXT = 200  # characters before a span in which its two words are looked for


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base patterns, by kind and start."""
    out = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign that overlap no span of ``taken``."""
    spans = sorted((a, b) for _, a, b in taken)
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        token = text[start:end]
        start += len(token) - len(token.lstrip(_EDGES))
        end -= len(token) - len(token.rstrip(_EDGES))
        if end - start >= 4 and not any(a < end and start < b for a, b in spans):
            yield start, end


def _mention(text: str, start: int, end: int) -> dict:
    before = text[max(0, start - _CONTEXT) : start].lower().split()[-2:]
    value = "".join(c for c in text[start:end].lower() if c.isalnum() or c in "@.")
    return {
        "start": start, "end": end, "pattern": " ".join(before),
        "instance": xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 3) - (1 << 63),
    }


def _form(value: str) -> list[str]:
    """Kinds that a candidate's form allows."""
    digits = sum(c.isdigit() for c in value)
    found = {"email": "@" in value, "ip": digits >= 4 and value.count(".") + value.count(":") >= 3, "card": digits >= 8, "phone": digits >= 6}
    return [k for k in KINDS if found[k]]


def mentions(docs: DataFrame) -> DataFrame:
    """Per row: row, doc_id, base (kind, start, end, pattern, instance), candidates (kinds, start, end, ...)."""
    common = [("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.int64())]
    base_type = pa.list_(pa.struct([("kind", pa.string()), *common]))
    other_type = pa.list_(pa.struct([("kinds", pa.list_(pa.string())), *common]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, others = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": KINDS[k], **_mention(text, a, b)} for k, a, b in spans])
                fits = ((_form(text[a:b]), a, b) for a, b in candidates(text, spans))
                others.append([{"kinds": kinds, **_mention(text, a, b)} for kinds, a, b in fits if kinds])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, type=base_type), pa.array(others, type=other_type)], ["doc_id", "base", "others"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    place = "start: bigint, `end`: bigint, pattern: string, instance: bigint"
    schema = f"doc_id {kind}, base array<struct<kind: string, {place}>>, others array<struct<kinds: array<string>, {place}>>"
    # the number is fixed by the write that follows
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def score_patterns(found: DataFrame, rounds: int = 3) -> DataFrame:
    """(pattern, kind, confidence, support) after ``rounds`` rounds over the pattern-instance graph."""
    seeds = found.select(F.explode("base").alias("m")).select("m.pattern", "m.instance", "m.kind")
    others = found.select(F.explode("others").alias("m")).select("m.pattern", "m.instance")
    edges = stored(seeds.select("pattern", "instance").union(others).filter("pattern <> ''").distinct(), "edges")
    known = stored(seeds.select("instance", "kind").distinct(), "seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    degrees = edges.groupBy("instance").agg(F.count("*").alias("degree"))
    scores = known.withColumn("score", F.lit(1.0))
    for k in range(rounds):
        # scores and patterns are written, so that both sides of each join are shuffled and a frequent pattern can be split
        sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("sum"), F.sum((F.col("score") >= 0.5).cast("long")).alias("support")
        )
        patterns = stored(
            sums.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("size") + 1)).alias("confidence"), "support"), "patterns"
        )
        if k + 1 < rounds:
            spread = edges.join(patterns, "pattern").groupBy("instance", "kind").agg(F.sum("confidence").alias("sum"))
            learned = spread.join(known.select("instance").distinct(), "instance", "left_anti").join(degrees, "instance")
            scores = stored(known.withColumn("score", F.lit(1.0)).unionByName(learned.select("instance", "kind", (F.col("sum") / F.col("degree")).alias("score"))), "scores")
    return patterns


def find_pii(docs: DataFrame, confidence: float = 0.6, support: int = 3, rounds: int = 3) -> DataFrame:
    """Per row: doc_id, base and found (arrays of kind, start, end); found has the base spans too."""
    rows = stored(mentions(docs), "mentions")
    good = score_patterns(rows, rounds).filter((F.col("confidence") >= confidence) & (F.col("support") >= support))
    others = rows.select("row", F.explode("others").alias("m")).select("row", "m.*")
    more = (
        others.join(stored(good, "good_patterns").select("pattern", "kind"), "pattern")
        .filter(F.array_contains("kinds", F.col("kind")))
        .groupBy("row")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    )
    plain = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")))
    ordered = F.transform(F.array_sort(F.transform(both, rank)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(more, "row", "left").select("doc_id", plain.alias("base"), ordered.alias("found"))
