"""Hashes of the words of a text, computed for all its words at once."""

from __future__ import annotations

import numpy as np

#: Bytes that part words: space and the ASCII controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(letters: np.ndarray, parts: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``parts`` does not mark."""
    inside = np.empty(len(letters) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~parts[letters]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``letters``: equal for equal spans."""
    power, inverse = _up_to(len(letters))
    sums = np.empty(len(letters) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """The hashes of the words of ``text`` in their order; none for null."""
    letters = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if lower:
        letters = LOWER[letters]
    starts, ends = spans(letters)
    return span_hashes(letters, starts, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in their order; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : k + count]
    return mix(out)
