"""Word shingles of texts as 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0xD6E8FEB86659FD93  # odd, so that it can be inverted modulo 2**64
_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9,
                     0xF1357AEA2E62A9C5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, with A-Z taken as a-z; which bytes end a word (blank, 0x09 to 0x0D)."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
    values[65:91] = values[97:123]
    ends = np.zeros(256, bool)
    ends[[0x20, *range(0x09, 0x0E)]] = True
    return values, ends


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first `n` powers of the prime; the table grows with the longest word, not with the text."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(256, 2 * n), _PRIME, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each row the index of its first word (one more entry at the end)."""
    n = len(data)
    values, ends = _bytes()
    inside = ~ends[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = inside[first]
    start = np.flatnonzero(opens)
    rows = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), rows
    letters = data[inside]
    begin = np.flatnonzero(opens[inside])
    length = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, length)
    sums = np.add.reduceat(values[letters] * powers(int(length.max()))[place], begin)
    return mixed(sums + length.astype(np.uint64) * _STEP), rows


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `words` words of a row (a shorter row: of all its words), and the rows' offsets in them."""
    if words > len(_WEIGHTS):
        raise ValueError(f"at most {len(_WEIGHTS)} words make a shingle")
    counts = np.diff(rows)
    made = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    first = rows[row] + np.arange(offsets[-1]) - offsets[row]
    width = np.minimum(counts[row], words)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    total = width.astype(np.uint64) * _STEP
    for k in range(words):
        total += np.where(k < width, padded[first + k], np.uint64(0)) * _WEIGHTS[k]
    return mixed(total), offsets


def distinct_sets(shingles: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct shingles in ascending order."""
    return [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
