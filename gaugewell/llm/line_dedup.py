"""Line dedup by pairwise alignment: blocks that an earlier document has go from the later one.

Documents overlap if they share a run of neighbouring lines of ``min_words`` words
or more. Such runs are cut as short as possible, those that start at a line and
those that end at one, and their hashes are rare even where single lines are not.
A run's partner is the first document (smallest doc_id) that has it, however many
have it, so a passage of very many documents makes a star around its first
holder, never all pairs, and a document has as many partners as it has passages
of different origin, a pair for each. Repeated runs are reduced to one row a
document before the shuffle.

The lines of each pair are then aligned (``align``) by patience diff: lines that
occur once in both are matched in order (longest increasing subsequence), the
ranges between them in the same way, and where no line is left that occurs once,
by the longest common block. Blocks that the alignment finds, and that have
``min_words`` words, go from the later document. What an alignment in order leaves
out, passages that are moved or repeated, is looked up by its shortest runs in the
same pair. So what goes is what aligning each document with all earlier ones,
again and again until no common block is left, would delete. In scripts
without spaces between words (Chinese, Japanese, Thai and others) a line may be a
single word, so a block also counts as long enough with twice ``min_words`` of their
characters; texts in other scripts are counted by words only.

Cases: lines are compared without white space at their ends. Blank lines are not
counted: they neither break a block nor are shared, and go where the lines on
both sides go. A null text has no lines and stays null. Documents are ordered by
doc_id and text; those without doc_id come last. Rows that agree in doc_id and
text are one document and treated alike: if it is the first with its lines, all
these rows keep them. What a document has twice itself, and no earlier one has,
stays. A document that loses all its lines has an empty text. Only ``text``
changes; other columns stay as they are.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

MIN_WORDS = 8
CHARS_A_WORD = 2
_TRIES = 1_000_000  # equal lines of two ranges, pair by pair, that the longest common block is looked for among
# Thai, Lao, Tibetan, Burmese, Khmer, Kana, Han
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _lines(text: str | None) -> list[str]:
    return [x for line in (text or "").split("\n") if (x := line.strip())]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def line_table(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_key, and of each line that isn't blank its hash, words and characters of unspaced scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, unspaced = [], [], []
            for text in batch.column(2):
                mine = _lines(text.as_py())
                lines.append([_hash(x) for x in mine])
                words.append([len(x.split()) for x in mine])
                unspaced.append([_unspaced(x) for x in mine])
            columns = [pa.array(lines, type=pa.list_(pa.int64())), *[pa.array(c, type=pa.list_(pa.int32())) for c in (words, unspaced)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "lines", "words", "unspaced"])

    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, lines array<long>, words array<int>, unspaced array<int>")


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, tops, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[k], tops[k] = v, i
        back[i] = tops[k - 1] if k else -1
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    """The lines that occur once in the range, with their place."""
    seen: dict[int, int] = {}
    for k in range(lo, hi):
        seen[lines[k]] = -1 if lines[k] in seen else k
    return {x: k for x, k in seen.items() if k >= 0}


def _longest(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common block (place in ``a``, place in ``b``, lines) of two ranges; 0 lines if too many lines repeat to try."""
    there: dict[int, list[int]] = {}
    for j in range(blo, bhi):
        there.setdefault(b[j], []).append(j)
    if sum(len(there.get(a[i], ())) for i in range(alo, ahi)) > _TRIES:
        return alo, blo, 0  # ``align`` finds such blocks by their runs
    best, before = (alo, blo, 0), {}
    for i in range(alo, ahi):
        now = {j: before.get(j - 1, 0) + 1 for j in there.get(a[i], ())}
        for j, k in now.items():
            if k > best[2]:
                best = (i - k + 1, j - k + 1, k)
        before = now
    return best


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal lines, in order in both texts."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        mine, theirs = _once(a, alo, ahi), _once(b, blo, bhi)
        common = [(k, theirs[x]) for x, k in mine.items() if x in theirs]  # in the order of ``a``
        if common:
            anchors = [common[k] for k in _increasing([j for _, j in common])]
            edges = [(alo, blo), *anchors, (ahi, bhi)]
            open_ += [(i, k, j, m) for (i, j), (k, m) in zip(edges, edges[1:])]
            continue
        i, j, n = _longest(a, b, alo, ahi, blo, bhi)
        if n:
            out += [(i + k, j + k) for k in range(n)]
            open_ += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [from, to) of the later document whose partners run along."""
    out: list[list[int]] = []
    last = None
    for a, b in pairs:
        if last and a - last[0] == b - last[1] == 1:
            out[-1][1] = a + 1
        else:
            out.append([a, a + 1])
        last = (a, b)
    return [(a, b) for a, b in out]


def align(mine: list[int], words: list[int], unspaced: list[int], theirs: list[int], least: int = MIN_WORDS) -> set[int]:
    """Places of the lines of the later document that are in a common block of ``least`` words with the earlier one.

    ``mine`` and ``theirs`` are the hashes of their lines; ``words`` and ``unspaced`` belong to ``mine``.
    """
    gone: set[int] = set()
    for a, b in blocks(patience(mine, theirs)):
        if sum(words[a:b]) >= least or sum(unspaced[a:b]) >= least * CHARS_A_WORD:
            gone |= set(range(a, b))
    if len(gone) == len(mine):
        return gone
    # moved and repeated passages: the shortest runs of the earlier document, within lines that both have
    size = {x: (w, u) for x, w, u in zip(mine, words, unspaced)}
    there: set[tuple[int, ...]] = set()
    at = 0
    while at < len(theirs):
        end = at
        while end < len(theirs) and theirs[end] in size:
            end += 1
        part = theirs[at:end]
        there |= {tuple(part[a:b]) for a, b in shortest_runs([size[x][0] for x in part], least, [size[x][1] for x in part])}
        at = end + 1
    for a, b in shortest_runs(words, least, unspaced):
        if tuple(mine[a:b]) in there:
            gone |= set(range(a, b))
    return gone


def _unspaced(line: str) -> int:
    """Characters of scripts that put no spaces between words."""
    return 0 if line.isascii() else len(_UNSPACED.findall(line))


def shortest_runs(words: list[int], least: int, unspaced: list[int] | None = None) -> set[tuple[int, int]]:
    """Runs [from, to) that are long enough and have no shorter such run with the same first, or the same last line.

    Long enough is ``least`` words, or CHARS_A_WORD times as many of the characters counted in ``unspaced``.
    """
    before, chars = [0, *accumulate(words)], [0, *accumulate(unspaced or [0] * len(words))]
    enough = lambda a, b: before[b] - before[a] >= least or chars[b] - chars[a] >= least * CHARS_A_WORD
    out, end, start = set(), 0, 0
    for a in range(len(words)):
        end = max(end, a + 1)
        while end <= len(words) and not enough(a, end):
            end += 1
        if end > len(words):
            break
        out.add((a, end))
    for b in range(1, len(words) + 1):
        while start + 1 < b and enough(start + 1, b):
            start += 1
        if enough(start, b):
            out.add((start, b))
    return out


def run_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per distinct shortest run and document: (doc_id, text_key, run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs = [], []

            def out() -> pa.RecordBatch:
                at = pa.array(rows, type=pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(runs, type=pa.int64())], ["doc_id", "text_key", "run"])

            for i, text in enumerate(batch.column(2)):
                lines = _lines(text.as_py())
                found = shortest_runs([len(x.split()) for x in lines], min_words, [_unspaced(x) for x in lines])
                mine = {_hash("\n".join(lines[a:b])) for a, b in found}
                rows += [i] * len(mine)
                runs += sorted(mine)
                if len(rows) > 50_000:
                    yield out()
                    rows, runs = [], []
            yield out()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, run long")


def partners(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct pairs (doc_id, text_key, owner_id, owner_key) of a document and the first one with a run of it."""
    runs = stored(run_table(docs, min_words), "runs")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = runs.groupBy("run").agg(F.min(rank).alias("first"), F.count("*").alias("docs"))
    # runs of one document only end here; written, so that both sides of the next join are shuffled and a frequent run can be split
    owners = stored(first.filter("docs > 1").select("run", "first.doc_id", "first.text_key").toDF("run", "owner_id", "owner_key"), "owners")
    shared = runs.join(owners, "run").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("owner_id")) & (F.col("text_key") == F.col("owner_key")))
    )
    return shared.select("doc_id", "text_key", "owner_id", "owner_key").distinct()


def common_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per later document that loses lines: doc_id, text_key, gone (positions), partners."""
    pairs = stored(partners(docs, min_words), "line_partners")
    lines = stored(line_table(docs).dropDuplicates(["doc_id", "text_key"]), "document_lines")
    p, d, o = pairs.alias("p"), lines.alias("d"), lines.alias("o")
    of = lambda side, i, k: F.col(f"{side}.doc_id").eqNullSafe(F.col(f"p.{i}")) & (F.col(f"{side}.text_key") == F.col(f"p.{k}"))
    both = p.join(d, of("d", "doc_id", "text_key")).join(o, of("o", "owner_id", "owner_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, keep = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                if found := align(*row, min_words):
                    keep.append(i)
                    gone.append(sorted(found))
            at = pa.array(keep, type=pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(gone, type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "gone"])

    kind = dict(docs.dtypes)["doc_id"]
    aligned = both.select("p.doc_id", "p.text_key", F.col("d.lines").alias("mine"), "d.words", "d.unspaced", F.col("o.lines").alias("theirs")).mapInArrow(
        run, f"doc_id {kind}, text_key long, gone array<int>"
    )
    return aligned.groupBy("doc_id", "text_key").agg(
        F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"), F.count("*").cast("int").alias("partners")
    )


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut(t, set(g)) for t, g in zip(text, gone)], dtype=object)


def cut(text: str, gone: set[int]) -> str:
    """The text without the lines at these positions, counted without blank lines."""
    kept: list[str] = []
    k, before, blanks = -1, False, []
    for line in text.split("\n"):
        if not line.strip():
            blanks.append(line)
            continue
        k += 1
        if not (k in gone and (before or k == 0)):
            kept += blanks
        blanks, before = [], k in gone
        if not before:
            kept.append(line)
    if not before:
        kept += blanks
    return "\n".join(kept)


def drop_common_lines(docs: DataFrame, min_words: int = MIN_WORDS, keep_empty: bool = True, counts: bool = False) -> DataFrame:
    """``docs`` with the common blocks deleted.

    Without ``keep_empty`` a document that loses all its lines goes. With
    ``counts`` columns n_gone (lines) and n_partners are added.
    """
    return _drop(docs, common_blocks(docs, min_words), keep_empty, counts)


def _drop(docs: DataFrame, gone: DataFrame, keep_empty: bool, counts: bool) -> DataFrame:
    d, g = docs.alias("d"), gone.alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    hit = F.col("g.gone").isNotNull()
    joined = d.join(g, same, "left").select(
        F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"),
        # only texts that change go through Python
        F.when(hit, _without(F.when(hit, F.col("d.text")), F.col("g.gone"))).alias("rest"),
        F.coalesce(F.size("g.gone"), F.lit(0)).alias("n_gone"),
        F.coalesce("g.partners", F.lit(0)).alias("n_partners"),
    )
    if not keep_empty:
        joined = joined.filter(F.col("rest").isNull() | (F.trim("rest") != ""))
    columns = [F.coalesce("rest", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*columns, *(["n_gone", "n_partners"] if counts else []))
