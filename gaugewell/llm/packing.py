"""Packing token sequences: vector bin packing with the dot-product heuristic.

Every document becomes the ids of its prompt (optional, no loss on them), those
of its text, and an end id. Pieces of documents are placed into sequences under
three limits at once: tokens, segments and loss-bearing tokens. A document with
more than a sequence's tokens first gives full sequences of its own. For the
rest a task keeps a pool of open pieces; into a sequence goes, step by step, the
piece that fits and whose demand has the largest dot product with the capacity
left, both as shares of the limits. When no piece fits, the one with the largest
product is cut to the capacity left. A sequence that the segment or loss limit,
or the end of the task's documents, leaves short is cut at a power of two, where
no padding is due, and what is cut off goes back to the pool.

Each task packs the rows of its own partition and numbers sequences by
partition, so there is no shuffle, and a task that is tried again gives the same
rows as long as its input rows come in the same order (files do). Memory: the
pool, ``POOL`` pieces of less than one sequence, and one document.

Cases: a null text or prompt is empty; such a document is its end id alone.
Repeated rows are packed as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import word_encoder

POOL = 256
_ROWS = 512  # pieces in an output batch


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass(slots=True)
class Piece:
    doc: tuple  # (doc_id, tokens of the document)
    start: int
    ids: bytes
    free: int  # leading ids that bear no loss
    size: int = field(init=False)
    loss: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = len(self.ids) // 4
        self.loss = max(0, self.size - self.free)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        rest = Piece(self.doc, self.start + n, self.ids[4 * n :], max(0, self.free - n))
        return Piece(self.doc, self.start, self.ids[: 4 * n], min(self.free, n)), rest


class Packer:
    """Sequences from a stream of pieces; each sequence is a list of pieces.

    ``need`` has the demands of the pool's pieces, a column a piece and a row a
    limit, as they come; ``share`` has them as shares of the limits. Columns of pieces
    that were placed are zero until the next ones move up.
    """

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.pool: list[Piece | None] = []
        self.need = np.zeros((3, 2 * POOL))
        self.share = np.zeros((3, 2 * POOL))
        self.held = 0  # pieces in the pool

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        full = self.limits.tokens
        while piece.size >= full and self._room(piece, full, self.limits.loss) == full:
            head, piece = piece.cut(full)
            yield [head]
        if not piece.size:
            return
        self._put(piece)
        if self.held >= POOL:
            while self.held > POOL // 2:
                yield self._next()

    def rest(self) -> Iterator[list[Piece]]:
        while self.held:
            yield self._next()

    def _put(self, piece: Piece, at: int | None = None) -> None:
        if at is None:
            if len(self.pool) == self.need.shape[1]:
                kept = [i for i, p in enumerate(self.pool) if p]
                self.pool = [self.pool[i] for i in kept]
                for table in (self.need, self.share):
                    table[:, : len(kept)] = table[:, kept]
            at = len(self.pool)
            self.pool.append(None)
            self.held += 1
        self.pool[at] = piece
        self.need[:, at] = (piece.size, 1, piece.loss)
        self.share[:, at] = self.need[:, at] / self.most

    @staticmethod
    def _room(piece: Piece, tokens: int, loss: int) -> int:
        """Leading ids of the piece that fit."""
        return min(piece.size, tokens, loss + piece.free)

    def _next(self) -> list[Piece]:
        left = self.most.copy()
        placed: list[Piece] = []
        while left[0] > 0 and left[1] > 0 and self.held:
            n = len(self.pool)
            score = (left / self.most) @ self.share[:, :n]
            # an open piece asks for a segment, so only columns of placed pieces score zero for it
            score[self.need[1, :n] == 0] = -1.0
            fits = np.where((self.need[:, :n] <= left[:, None]).all(axis=0), score, -1.0)
            at = int(fits.argmax())
            whole = fits[at] >= 0
            if not whole:
                at = int(score.argmax())
            room = self._room(self.pool[at], int(left[0]), int(left[2]))
            if not room:
                break  # no loss left, and the best piece bears loss at once
            if whole:
                piece, self.pool[at] = self.pool[at], None
                self.need[:, at] = self.share[:, at] = 0
                self.held -= 1
            else:
                piece, rest = self.pool[at].cut(room)
                self._put(rest, at)
            placed.append(piece)
            left -= (piece.size, 1, piece.loss)
        return self._even(placed)

    def _even(self, placed: list[Piece]) -> list[Piece]:
        """Cut to a power of two unless full."""
        total = sum(p.size for p in placed)
        if total == self.limits.tokens:
            return placed
        over = total - (1 << (total.bit_length() - 1))
        while over:
            last = placed.pop()
            if last.size > over:
                head, last = last.cut(last.size - over)
                placed.append(head)
            over -= last.size
            self._put(last)
        return placed


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizers file on every executor. ``prompt``
    names the column with the prompts, if there are any.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    prompts = F.col(f"`{prompt}`").cast("string") if prompt else F.lit(None).cast("string")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = word_encoder(vocabulary), Packer(limits)
        number = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def write(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in pieces:
                out.append((p.doc[0], p.start, p.size, p.ids, p.doc[1], p.loss, number, offset))
                offset += p.size
            number += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in names])

        names = [x.strip().split(" ", 1) for x in schema.split(", ")]
        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.binary() if t == "binary" else pa.int64() for _, t in names[1:]]]
            for doc_id, text, before in zip(*(batch.column(c) for c in range(3))):
                head = encode(before.as_py())
                ids = head + encode(text.as_py()) + end
                for placed in packer.add(Piece((doc_id.as_py(), len(ids) // 4), 0, ids, len(head) // 4)):
                    write(placed)
                if len(out) >= _ROWS:
                    yield flush()
        for placed in packer.rest():
            write(placed)
        encode.forget()
        if out:
            yield flush()

    return docs.select("doc_id", "text", prompts.alias("prompt")).mapInArrow(run, schema)
