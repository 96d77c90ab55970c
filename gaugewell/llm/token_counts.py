"""Token counts of a document's sections, from one encoding of the whole document.

The whole text is encoded once. Token lengths give each token's span, and an
interval join, a binary search of the spans in the sections' ends, tells in
which sections it begins and ends. A token that crosses a section's end goes, by
``rule``, to the section of its first byte (``first``), of its last (``last``),
or to the one that holds most of its bytes (``most``; the earlier one of equals).
So the sections' counts add up to the document's.

A section ends after each match of ``separator``; the last one at the text's end.

Cases: a null or empty text has one empty section without tokens. Text that looks
like a special token is encoded as ordinary text. Rows are handled one by one,
repeated ones too. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = ("first", "last", "most")
_ROWS = 20_000


def encoding(path: str, pattern: str):
    """A byte-pair encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def allocate(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; ``sizes``: bytes of the tokens, ``ends``: byte ends of the sections."""
    to = np.cumsum(sizes)
    first = np.searchsorted(ends, to - sizes, "right")
    last = np.searchsorted(ends, to - 1, "right")
    crossing = np.flatnonzero(first != last)
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for k in crossing.tolist():
            at = np.arange(first[k], last[k] + 1)
            begins = np.concatenate([[0], ends])[at]
            held = np.minimum(ends[at], to[k]) - np.maximum(begins, to[k] - sizes[k])
            owner[k] = at[np.argmax(held)]
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[crossing], minlength=len(ends))


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, separator: str = r"\n", rule: str = "most") -> DataFrame:
    """A row per section: doc_id, section, start, end (code points), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule: {rule}")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(vocabulary, pattern)
        size_of = np.array([len(codec.decode_single_token_bytes(i)) for i in range(codec.n_vocab)])
        cut = re.compile(separator)
        for batch in batches:
            row: list[np.ndarray] = []
            parts: list[np.ndarray] = []

            def out() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(np.concatenate(row) if row else np.array([], dtype=np.int64)))
                values = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), dtype=np.int64)
                return pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in values)], ["doc_id", *names])

            held = 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                at = [m.end() for m in cut.finditer(text) if m.end() > m.start()]
                if not at or at[-1] < len(text):
                    at.append(len(text))
                begins = [0, *at[:-1]]
                ends = np.cumsum([len(text[a:b].encode()) for a, b in zip(begins, at)])
                counts, crossing = allocate(size_of[codec.encode_ordinary(text)] if text else np.array([], dtype=np.int64), ends, rule)
                row.append(np.full(len(at), i))
                parts.append(np.array([range(len(at)), begins, at, counts, crossing], dtype=np.int64))
                if (held := held + len(at)) > _ROWS:
                    yield out()
                    row, parts, held = [], [], 0
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, section long, start long, `end` long, n_tokens long, n_crossing long")
