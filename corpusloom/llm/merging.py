"""Merge tables of byte-pair vocabularies, shared by encoding and counting."""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """For two neighbouring symbols the rank of their merge and the symbol that it makes.

    `pieces` are the strings of the vocabulary, a symbol is an index into them, `ranks` their priorities (lower goes
    first; equal ones go from left to right). Two symbols merge if their strings joined are a piece.
    """

    def __init__(self, pieces: list, ranks: np.ndarray):
        known = {p: i for i, p in enumerate(pieces)}
        keys, made = [], []
        for i, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(-1 << 62) * -1)
        self.made = np.append(np.array(made, np.int32)[order], np.int32(-1))
        self.ranks = np.append(np.asarray(ranks, np.int32), NO_RANK)
        self._pairs: dict[int, int] | None = None

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that pairs make, -1 for pairs that do not merge; symbols below 0 never merge."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = len(self.keys) - 1
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], np.int32(-1))

    def rank(self, made: np.ndarray) -> np.ndarray:
        return self.ranks[made]  # -1 is the last entry

    def merge_one(self, symbols: list[int]) -> list[int]:
        """All merges of one sequence, one by one: always the lowest rank, the leftmost of equal ones."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys[:-1].tolist(), self.made[:-1].tolist()))
        pairs, ranks = self._pairs, self.ranks
        n = len(symbols)
        symbols, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (made := pairs.get(symbols[i] << 32 | symbols[j])) is not None:
                heapq.heappush(heap, (int(ranks[made]), i, made, j))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, made, j = heapq.heappop(heap)
            if symbols[i] is None or after[i] != j or symbols[j] is None or pairs.get(symbols[i] << 32 | symbols[j]) != made:
                continue
            symbols[i], symbols[j], after[i] = made, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]


def leftmost_apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places, those to merge from left to right if neighbours that overlap exclude each other."""
    if len(at) < 2:
        return np.ones(len(at), bool)
    chained = np.concatenate([[False], after[:-1] == at[1:]])
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return (np.arange(len(at)) - start) % 2 == 0
