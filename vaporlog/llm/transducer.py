"""Minimal acyclic transducers that map the terms of a sorted list to their ordinals.

States are made from sorted terms, one at a time: what the next term does not share with the last one is finished,
and a finished state equal to an earlier one is that state. An arc carries the number of terms that come before
those behind it, so the sum along a path is the term's place in the list. Terms are non-empty bytes.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """States and arcs as arrays; arcs are sorted by state and byte."""

    def __init__(self, root: int, final: np.ndarray, codes: np.ndarray, targets: np.ndarray, outputs: np.ndarray) -> None:
        self.root, self.final, self.codes, self.targets, self.outputs = root, final, codes, targets, outputs

    @classmethod
    def of_sorted(cls, terms: Iterable[bytes]) -> Transducer:
        """From different terms in ascending order."""
        known: dict[tuple, int] = {}
        below: list[int] = []  # terms that can be read from a state
        open_states: list[tuple[list, list]] = [([False], [])]
        labels: list[int] = []
        last = b""

        def finish() -> int:
            (final,), arcs = open_states.pop()
            key = (final, *arcs)
            if key not in known:
                known[key] = len(below)
                below.append(final + sum(below[target] for _, target in arcs))
            return known[key]

        for term in terms:
            if term <= last:
                raise ValueError(f"{term!r} does not come after {last!r}")
            shared = next((i for i, (x, y) in enumerate(zip(last, term, strict=False)) if x != y), min(len(last), len(term)))
            while len(labels) > shared:
                state = finish()
                open_states[-1][1].append((labels.pop(), state))
            for byte in term[shared:]:
                open_states.append(([False], []))
                labels.append(byte)
            open_states[-1][0][0] = True
            last = term
        while labels:
            state = finish()
            open_states[-1][1].append((labels.pop(), state))
        root = finish()

        codes, targets, outputs, finals = [], [], [], np.zeros(len(below), bool)
        for state, (final, *arcs) in enumerate(known):
            finals[state] = final
            before = int(final)
            for byte, target in arcs:
                codes.append(state << 8 | byte)
                targets.append(target)
                outputs.append(before)
                before += below[target]
        return cls(root, finals, np.array(codes, "int64"), np.array(targets, "int64"), np.array(outputs, "int64"))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinals of terms in a row of bytes; -1 for what is no term. All terms are read together, one byte at a time."""
        n = len(starts)
        state, total = np.full(n, self.root, "int64"), np.zeros(n, "int64")
        found = np.zeros(n, bool)
        reading = np.arange(n)
        depth = 0
        while len(reading) and len(self.codes):
            ended = lengths[reading] == depth
            stop = reading[ended]
            found[stop] = self.final[state[stop]]
            reading = reading[~ended]
            code = state[reading] << 8 | data[starts[reading] + depth]
            at = np.searchsorted(self.codes, code)
            at[at == len(self.codes)] = 0
            there = self.codes[at] == code
            reading, at = reading[there], at[there]
            total[reading] += self.outputs[at]
            state[reading] = self.targets[at]
            depth += 1
        return np.where(found, total, -1)

    def term(self, ordinal: int) -> bytes:
        """The term with an ordinal."""
        state, path = self.root, bytearray()
        while ordinal or not self.final[state]:
            first, stop = np.searchsorted(self.codes, [state << 8, (state + 1) << 8])
            at = first + np.searchsorted(self.outputs[first:stop], ordinal, "right") - 1
            if at < first:
                raise IndexError("no term has this ordinal")
            path.append(int(self.codes[at]) & 255)
            ordinal -= int(self.outputs[at])
            state = int(self.targets[at])
        return bytes(path)

    def to_bytes(self) -> bytes:
        """All arrays in one piece."""
        sink = io.BytesIO()
        for array in (np.array([self.root], "int64"), self.final, self.codes, self.targets.astype("uint32"), self.outputs.astype("uint32")):
            np.save(sink, array, allow_pickle=False)
        return sink.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        """What `to_bytes` gave."""
        source = io.BytesIO(data)
        root, final, codes, targets, outputs = (np.load(source, allow_pickle=False) for _ in range(5))
        return cls(int(root[0]), final, codes, targets.astype("int64"), outputs.astype("int64"))
