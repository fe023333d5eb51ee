"""Sorted runs of byte strings: front coding, and merging by a loser tree that knows common prefixes.

Within a run each string carries the length of the prefix it shares with the one before it. The tree keeps for each loser
how much it shares with the string that beat it, so a comparison starts behind what is known to be equal, and is
decided without looking at the strings where the known lengths differ.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

_HEAD = struct.Struct("<HHH")


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix of a and b, known to be at least ``at``."""
    n = min(len(a), len(b))
    step = 64
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at = min(n, at + step)
        elif step == 1:
            break
        else:
            step //= 2
    return at


def front_code(rows: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (string, payload) rows as one block; strings and payloads of less than 64 KB each."""
    out, before = [], b""
    for text, payload in rows:
        n = shared(before, text)
        out += (_HEAD.pack(n, len(text) - n, len(payload)), text[n:], payload)
        before = text
    return b"".join(out)


def decode(block: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """The rows of a block as (string, prefix shared with the one before, payload)."""
    at, text = 0, b""
    while at < len(block):
        n, rest, size = _HEAD.unpack_from(block, at)
        at += _HEAD.size
        text = text[:n] + block[at : at + rest]
        yield text, n, block[at + rest : at + rest + size]
        at += rest + size


class LoserTree:
    """Merges sorted runs; iterating gives (string, prefix shared with the string before, payload) in order."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, bytes]]]):
        self.runs = runs
        self.leaves = 1
        while self.leaves < max(1, len(runs)):
            self.leaves *= 2
        self.head: list[tuple[bytes, int, bytes] | None] = [next(r, None) for r in runs] + [None] * (self.leaves - len(runs))
        #: of each run's head what it shares with the last winner it was compared with
        self.known = [0] * self.leaves
        self.loser = [0] * self.leaves
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = self._play(a, b)
        self.loser[node] = lost
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; both know what they share with one and the same smaller string."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.known[a], self.known[b]
        if p != q:  # the one that shares more with the smaller string is the smaller one
            return (a, b) if p > q else (b, a)
        n = shared(x[0], y[0], p)
        won, lost = (a, b) if x[0][n : n + 1] <= y[0][n : n + 1] else (b, a)
        self.known[lost] = n
        return won, lost

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        while (top := self.head[self.winner]) is not None:
            run = self.winner
            yield top[0], self.known[run], top[2]
            following = next(self.runs[run], None) if run < len(self.runs) else None
            self.head[run] = following
            self.known[run] = following[1] if following else 0
            won, node = run, (run + self.leaves) // 2
            while node:
                won, self.loser[node] = self._play(won, self.loser[node])
                node //= 2
            self.winner = won
