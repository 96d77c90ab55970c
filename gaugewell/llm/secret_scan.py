"""Secret scan: all rules in one pass over the bytes with one automaton.

The rules' patterns are compiled together into one minimal automaton that a
match may enter at every byte. Bytes that lead every state back to the start
without a match (line ends, commas, most symbols, all of what is beyond ASCII)
cut a batch of texts into segments, and the automaton runs over all segments in
step: numpy moves every segment by one byte at a time, so the pass costs a few
array look-ups a byte. It reports which rules end a match in which segment. The
exact spans of those rules in those segments come from the rules' own
automata: leftmost, longest, not overlapping; a match that is too short is
dropped and its bytes are not searched again.

Cases: a null text counts as empty. Offsets are code points, end exclusive.
Every row gets its own result, also repeated rows and rows without doc_id. Other
columns are not read. Without rules there are no findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, build


@dataclass(frozen=True)
class Rule:
    """``lead`` is what stands before the secret; ``body`` the secret, of ``least`` bytes (or, with ``whole``, lead and body)."""

    kind: str
    lead: str
    body: str
    least: int
    whole: bool = False
    short: str = ""  # the least number of body bytes that the common pass waits for, as a quantifier

    @property
    def pattern(self) -> str:
        return f"{self.lead}{self.body}"


_WORD = "[A-Za-z0-9]"
# The first three are the base rules; the others are public token formats.
RULES = [
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "AKIA", "[A-Z0-9]+", 18, whole=True),
    Rule("hex", "", "[0-9a-f]+", 16, short="{16,}"),
    Rule("github", "gh[pousr]_", f"{_WORD}+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("stripe", "[sr]k_(live|test)_", f"{_WORD}+", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 8),
    Rule("private_key", "-----BEGIN [A-Z ]*", "PRIVATE KEY-----", 1),
]
BASE = 3


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]

    @cached_property
    def common(self) -> Automaton:
        # one byte of the body (or ``short``) is enough to look closer, and keeps the automaton small
        return build([r.lead + r.body.removesuffix("+") + r.short for r in self.rules], anywhere=True)

    @cached_property
    def own(self) -> list[tuple[Automaton, Automaton | None]]:
        return [(build([r.pattern]), build([r.lead]) if r.lead and not r.whole else None) for r in self.rules]

    @cached_property
    def resets(self) -> np.ndarray:
        """Classes that lead every state to the start."""
        return (self.common.table[1:] == 1).all(axis=0)

    @cached_property
    def first(self) -> list[np.ndarray]:
        """Of each rule, the bytes that a match can begin with."""
        return [whole.table[1][whole.classes] > 0 for whole, _ in self.own]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments [start, end) in which rules end a match, and the rules as bits."""
        table, accepts, classes = self.common.table, self.common.accepts, self.common.classes[data]
        live = np.empty(len(data) + 1, dtype=bool)
        live[:-1], live[-1] = ~self.resets[classes], False
        begins = live[:-1].copy()
        begins[1:] &= ~live[:-2]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] |= live[inner]
        start = np.flatnonzero(begins)
        ends = ~live[1:] & live[:-1]
        ends[inner - 1] |= live[inner - 1]
        end = np.flatnonzero(ends) + 1
        wanted = end - start >= min(4, *(r.least for r in self.rules))
        start, end = start[wanted], end[wanted]
        order = np.argsort(start - end, kind="stable")  # the longest first
        start, end = start[order], end[order]
        seen = np.zeros(len(start), dtype=np.int64)
        for at in range(0, len(start), 1 << 14):
            lanes = start[at : at + (1 << 14)]
            size = (end[at : at + (1 << 14)] - lanes)[::-1]
            state = np.ones(len(lanes), dtype=table.dtype)
            found = seen[at : at + (1 << 14)]
            for k in range(int(size[-1]) if len(size) else 0):
                n = len(size) - int(np.searchsorted(size, k, "right"))
                now = table[state[:n], classes[lanes[:n] + k]]
                state[:n] = now
                hit = accepts[now]
                if hit.any():
                    found[:n] |= hit
        some = seen > 0
        return start[some], end[some], seen[some]

    def spans(self, rule: int, piece: bytes) -> Iterator[tuple[int, int]]:
        whole, lead = self.own[rule]
        r, first, at = self.rules[rule], self.first[rule], 0
        while at < len(piece):
            end = whole.longest(piece, at) if first[piece[at]] else -1
            if end < 0:
                at += 1
                continue
            if end - (lead.longest(piece, at) if lead else at) >= r.least:
                yield at, end
            at = end


def _column_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row, and each text's bounds; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row: doc_id, found (array of kind, start, end; by start, then the rules' order)."""
    kind = dict(docs.dtypes)["doc_id"]
    scanner = Scanner(tuple(rules))
    if rules:
        scanner.common, scanner.own  # compiled once, here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[tuple[int, int, int]]] = {}
            if rules and len(batch):
                data, offsets = _column_bytes(batch.column(1))
                for a, b, bits in zip(*(x.tolist() for x in scanner.segments(data, offsets))):
                    doc = int(np.searchsorted(offsets, a, "right")) - 1
                    piece = data[a:b].tobytes()
                    for k in range(len(rules)):
                        if bits >> k & 1:
                            found.setdefault(doc, []).extend((a + s, k, a + e) for s, e in scanner.spans(k, piece))
            out = []
            for i in range(len(batch)):
                rows, done, chars = [], 0, 0
                # bytes to code points, walking once through the text
                base = int(offsets[i]) if i in found else 0
                for s, k, e in sorted(found.get(i, ())):
                    s, e = s - base, e - base
                    chars += len(data[base + done : base + s].tobytes().decode("utf-8", "surrogatepass"))
                    done = s
                    rows.append({"kind": rules[k].kind, "start": chars, "end": chars + e - s})  # matches are ASCII
                out.append(rows)
            spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=spans)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind: string, start: bigint, `end`: bigint>>")
