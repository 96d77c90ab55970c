"""Ranked lexical search: all items against all documents, by one automaton over the texts.

The distinct terms of the items, each between two blanks, make one Aho-Corasick
automaton. A text is brought to the same form (A-Z lower-cased, every run of other
ASCII characters than letters and digits a blank) and read once; the automaton's
matches are then just the occurrences of whole terms, so the term frequencies come
from the text itself and no index of the documents is made. Terms map to the
items that have them, and a match adds to the scores of those items.

The documents are scanned twice. The first scan gives the statistics: documents
and terms in all, and per term of the items the documents that hold it, summed
within each task. The second gives scores; a task keeps the ``k`` best of each
item, and the best of all tasks are ranked in two steps. Only the automaton and
the statistics of its terms are sent to executors. Items beyond ``BLOCK`` terms
are worked off in blocks, each with an automaton of its own, so this is bounded
for any number of items. Scores are sums of 64-bit integers.

Cases: a null text has no terms, like an empty one, and is in no result. Items
without terms, or whose terms no document holds, are in no result. Rows with the
same item_id are one item that has the terms of all of them; null is an id too.
Repeated documents are documents of their own. Equal scores are ranked by
ascending doc_id, null last. Without documents or items there are no rows. Columns
besides doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import words

BLOCK = 200_000  # (item, term) rows of the items that are searched in one scan, at about most
_CELLS = 1 << 21  # scores in memory at once
_SHARES = 256
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)  # the byte that stands for each byte of UTF-8


def plain(text: str | None) -> bytes:
    """The text's terms with blanks around and between them."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES) + b" "


def count_terms(form: bytes) -> int:
    term = np.frombuffer(form, dtype=np.uint8) != 32
    return int(np.count_nonzero(term[1:] & ~term[:-1]))


@dataclass
class Terms:
    """The automaton of a block of items. ``starts`` and ``items`` map term t to items[starts[t]:starts[t + 1]]."""

    automaton: object
    starts: np.ndarray
    items: np.ndarray
    n_items: int

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Terms:
        """``rows``: distinct (item number, term)."""
        import ahocorasick

        by_term: dict[str, list[int]] = {}
        for item, term in rows:
            by_term.setdefault(term, []).append(item)
        automaton = ahocorasick.Automaton()
        for t, term in enumerate(by_term):
            # a character for each byte
            automaton.add_word(f" {term.encode('utf-8').decode('latin-1')} ", t)
        automaton.make_automaton()
        starts = np.cumsum([0, *map(len, by_term.values())])
        return Terms(automaton, starts, np.array([i for x in by_term.values() for i in x], dtype=np.int64), 1 + max(i for i, _ in rows))

    def frequencies(self, form: bytes) -> Counter:
        """Term number to occurrences."""
        return Counter(map(itemgetter(1), self.automaton.iter(form.decode("latin-1"))))


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    return items.select("item_id", F.explode(words(F.col("text"))).alias("term")).distinct()


def statistics(docs: DataFrame, terms: Broadcast) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents per term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = terms.value
        size = len(block.starts) - 1
        df = np.zeros(size, dtype=np.int64)
        documents = length = 0
        for batch in batches:
            for text in batch.column(0):
                form = plain(text.as_py())
                n = count_terms(form)
                documents += n > 0
                length += n
                df[list(block.frequencies(form))] += 1
        seen = np.nonzero(df)[0]
        key, value = np.concatenate([[-2, -1], seen]), np.concatenate([[documents, length], df[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(key, type=pa.int64()), pa.array(value, type=pa.int64())], ["key", "value"])

    # a row for each term of the block at most
    sums = docs.select("text").mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    found = dict(zip(sums["key"].to_pylist(), sums["value"].to_pylist()))
    df = np.array([found.get(t, 0) for t in range(len(terms.value.starts) - 1)], dtype=np.int64)
    return found.get(-2, 0), found.get(-1, 0), df


class Best:
    """The k best (score, doc_id) of each item; equal scores by ascending doc_id, null (by ``none``) last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.least = np.zeros(n_items, dtype=np.int64)  # the k-th best score so far
        self.rows = np.zeros((4, 0), dtype=np.int64)  # item, score, none, doc_id
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, scores: np.ndarray, doc_id: np.ndarray, none: np.ndarray) -> None:
        """``scores``: documents x items."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.new.append(np.stack([item, scores[doc, item], none[doc], doc_id[doc]]))
        self.size += len(doc)
        if self.size > _CELLS // 8:
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *self.new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        item = rows[0]
        starts = np.searchsorted(item, item)
        place = np.arange(len(item)) - starts
        self.rows, self.new, self.size = rows[:, place < self.k], [], 0
        full = place == self.k - 1
        self.least[item[full]] = rows[1][full]


def _expand(terms: Terms, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores, documents x items, from what each (document, term) adds to each item that has the term."""
    per = terms.starts[term + 1] - terms.starts[term]
    first = np.repeat(terms.starts[term] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    item = terms.items[first + np.arange(per.sum())]
    scores = np.zeros(n_docs * terms.n_items, dtype=np.int64)
    np.add.at(scores, np.repeat(doc, per) * terms.n_items + item, np.repeat(value, per))
    return scores.reshape(n_docs, terms.n_items)


def best_in_tasks(docs: DataFrame, terms: Broadcast, documents: int, length: int, weight: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score) of the k best of every task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = terms.value
        best = Best(block.n_items, k)
        most = max(1, _CELLS // block.n_items)
        doc_id, doc, term, tf, m = [], [], [], [], []

        def score() -> None:
            at, which, often = (np.array(x, dtype=np.int64) for x in (doc, term, tf))
            value = weight[which] * (1_000_000_000 * often // (1000 * often + 8 * np.array(m, dtype=np.int64)[at]))
            ids = pa.array(doc_id, type=pa.int64())
            none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            best.add(_expand(block, at, which, value, len(doc_id)), ids.fill_null(0).to_numpy(), none)
            for x in (doc_id, doc, term, tf, m):
                x.clear()

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                form = plain(text.as_py())
                if found := block.frequencies(form):
                    doc += [len(doc_id)] * len(found)
                    term += found.keys()
                    tf += found.values()
                    m.append(10 + 90 * count_terms(form) * documents // length)
                    doc_id.append(name.as_py())
                if len(doc_id) >= most or len(doc) > _CELLS:
                    score()
        if doc_id:
            score()
        best.settle()
        item, points, none, ids = best.rows
        columns = [pa.array(item), pa.array(ids, mask=none.astype(bool)), pa.array(points)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")


def _rank(rows: DataFrame, k: int) -> DataFrame:
    """Ranks from 1; first among a share of the tasks' rows, so that no group holds those of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    share = rows.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(_SHARES)))
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("share")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k documents with the highest score above 0 for each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    pairs = stored(item_terms(items), "item_terms")
    blocks = max(1, -(-pairs.count() // block))
    # items of a block get numbers there; an item's terms are all in one block
    in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        mine = pairs.filter(in_block == b)
        names = [r[0] for r in mine.select("item_id").distinct().collect()]
        number = {name: i for i, name in enumerate(names)}
        rows = [(number[r.item_id], r.term) for r in mine.collect()]
        if not rows:
            continue
        terms = spark.sparkContext.broadcast(Terms.of(rows))
        documents, length, df = statistics(docs, terms)
        if not documents:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        found = _rank(best_in_tasks(docs, terms, documents, length, weight, k), k)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
        found = found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
