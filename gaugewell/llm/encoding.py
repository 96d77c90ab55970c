"""Token ids inside tasks, with public vocabulary files."""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache

assert sys.byteorder == "little" and array("I").itemsize == 4


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file ``name`` is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_pattern() -> str:
    """The word pattern that goes with the byte-level rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


# Marks that end a chunk as a pre-token of their own; none of them is part of a special token.
_MARKS = ".,;:!?#&$*%)"


class WordEncoder:
    """Ids for vocabularies whose pre-tokenizer drops white space, as little-endian 32-bit bytes.

    Such a vocabulary encodes what lies between two blanks alone, whatever stands
    around it, so the ids of a text are those of its chunks in a row. It is also
    byte-level, folds case and parts letters from marks, so a word is encoded once
    for all its forms with capitals, a full stop or a comma. What was encoded is kept in
    two generations of at most ``keep`` chunks; the older one goes when the
    younger is full, and chunks still in use move on.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        known = self.known
        if new := set(chunks).difference(known):
            if len(known) + len(new) > self.keep:
                known, self.old = {"": b""}, known
                self.known, new = known, set(chunks)
            self._learn(new)
        return b"".join(map(known.__getitem__, chunks))

    def forget(self) -> None:
        """Keep the younger generation only; for the end of a task, whose worker may go on with other work."""
        self.old = {}

    def _learn(self, chunks: set[str]) -> None:
        known, old, tokenize = self.known, self.old, self.model.tokenize
        forms, missing = [], set()
        for chunk in chunks:
            if chunk in old:
                known[chunk] = old[chunk]
                continue
            marks = ""
            if chunk.isascii() and chunk.isalpha():
                plain, simple = chunk.lower(), True
            else:
                plain = chunk.rstrip(_MARKS)
                if not plain or not plain[-1].lower().isalpha():  # as the vocabulary sees it, folded
                    plain = chunk
                marks = chunk[len(plain) :]
                if simple := plain.isascii() and plain.isalpha():
                    plain = plain.lower()
            ids = known.get(plain)
            if ids is None:
                ids = old.get(plain)
                if ids is None and simple:
                    # one pre-token, which nothing before the model changes
                    ids = array("I", [t.id for t in tokenize(plain)]).tobytes()
                if ids is not None:
                    known[plain] = ids
            if ids is None:
                missing.add(plain)
                forms.append((chunk, plain, marks))
            elif marks:
                known[chunk] = ids + self._mark(marks)
            else:
                known[chunk] = ids
        known.update(self._encode(list(missing)))
        for chunk, plain, marks in forms:
            known[chunk] = known[plain] + self._mark(marks)

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 1000:
                self.marks = {"": b""}
            self.marks.update(self._encode([marks]))
        return self.marks[marks]

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False) if chunks else []
        return {c: array("I", e.ids).tobytes() for c, e in zip(chunks, encoded)}


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; what it has learned serves the worker's later tasks."""
    return WordEncoder(path)
