"""One deterministic automaton for many byte patterns.

Patterns: literal bytes, ``\\xHH`` and escaped characters, ``[...]`` and
``[^...]``, groups, ``(?i:...)``, ``|``, and ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    """Thompson's construction: byte edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def pattern(self, text: str) -> tuple[int, int]:
        self.text, self.at, self.fold = text, 0, False
        out = self._choice()
        if self.at != len(text):
            raise ValueError(f"{text!r} at {self.at}")
        return out

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self, wanted: str = "") -> str:
        c = self._peek()
        if not c or wanted and c != wanted:
            raise ValueError(f"{self.text!r} at {self.at}")
        self.at += 1
        return c

    def _choice(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        start, end = self.state(), self.state()
        for a, b in parts:
            self.empty[start].append(a)
            self.empty[b].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            begun = self.at
            least, most, ended = self._counts()
            for k in range(max(least, most or 0) or 1):
                self.at = begun
                a, b = self._atom()
                self.empty[end].append(a)
                if k >= least:
                    self.empty[a].append(b)
                if most is None and k == max(least, 1) - 1:
                    self.empty[b].append(a)
                end = b
            self.at = ended
        return start, end

    def _counts(self) -> tuple[int, int | None, int]:
        """Least and most repetitions of the atom that begins here, and where its quantifier ends."""
        edges, empty = [*map(list, self.edges)], [*map(list, self.empty)]
        self._atom()
        self.edges, self.empty = edges, empty
        q = self._peek()
        if q and q in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[q] + (self.at,)
        if q == "{":
            close = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : close].partition(",")
            return int(low), (int(high) if high else None if comma else int(low)), close + 1
        return 1, 1, self.at

    def _atom(self) -> tuple[int, int]:
        c = self._take()
        if c == "(":
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            out = self._choice()
            self.fold = fold
            self._take(")")
            return out
        chars = self._set() if c == "[" else {self._byte(c)}
        if self.fold:
            chars |= {ord(x) for b in chars if b < 128 for x in (chr(b).lower(), chr(b).upper())}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(chars), b))
        return a, b

    def _byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self._take()
        if c != "x":
            return ord(c)
        return int(self._take() + self._take(), 16)

    def _set(self) -> set[int]:
        negated = self._peek() == "^"
        self.at += negated
        out: set[int] = set()
        while (c := self._take()) != "]":
            low = high = self._byte(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte(self._take())
            out |= set(range(low, high + 1))
        return set(range(256)) - out if negated else out


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte class]`` -> state; state 0 is dead, 1 the start; ``accepts[state]`` has a bit for each pattern."""

    table: np.ndarray
    accepts: np.ndarray
    classes: np.ndarray  # of each byte

    def longest(self, data: bytes, at: int) -> int:
        """Where the longest match that begins at ``at`` ends, or -1."""
        state, end = 1, -1
        for k in range(at, len(data)):
            state = self.table[state, self.classes[data[k]]]
            if not state:
                break
            if self.accepts[state]:
                end = k + 1
        return end


def build(patterns: list[str], anywhere: bool = False) -> Automaton:
    """Subset construction and minimisation. With ``anywhere`` a match may begin at every byte."""
    nfa = _Nfa()
    ends: dict[int, int] = {}
    starts = []
    for k, p in enumerate(patterns):
        a, b = nfa.pattern(p)
        starts.append(a)
        ends[b] = 1 << k

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    # bytes that no pattern tells apart are one class
    sets = list({chars for edges in nfa.edges for chars, _ in edges})
    signs: dict[tuple[bool, ...], int] = {}
    classes = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)], dtype=np.uint8)
    sample = [int(np.argmax(classes == c)) for c in range(len(signs))]

    start = closure(set(starts))
    known: dict[frozenset[int], int] = {frozenset(): 0, start: 1}
    todo, rows = [start], {0: [1 if anywhere else 0] * len(sample)}
    while todo:
        now = todo.pop()
        row = []
        for byte in sample:
            to = {t for s in now for chars, t in nfa.edges[s] if byte in chars}
            nxt = closure(to | set(starts)) if anywhere else closure(to)
            if nxt not in known:
                known[nxt] = len(known)
                todo.append(nxt)
            row.append(known[nxt])
        rows[known[now]] = row
    table = np.array([rows[s] for s in range(len(rows))])
    accepts = np.zeros(len(table), dtype=np.int64)
    for states, s in known.items():
        accepts[s] = sum(ends.get(x, 0) for x in states)
    return _minimal(table, accepts, classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Automaton:
    """Moore's refinement; the dead state stays 0 and the start 1."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        # the numbers of a state's own group and of those its bytes lead to
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    group = group.ravel()
    order = {group[0]: 0}
    order.setdefault(group[1], len(order))
    for g in group.tolist():
        order.setdefault(g, len(order))
    new = np.array([order[g] for g in group.tolist()])
    if new[1] == 0:
        raise ValueError("the patterns match nothing")
    out, seen = np.zeros((len(order), table.shape[1]), dtype=np.int32), np.zeros(len(order), dtype=np.int64)
    out[new], seen[new] = new[table], accepts
    return Automaton(out, seen, classes)
