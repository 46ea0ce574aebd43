"""Rolling hashes and window selection over numpy arrays.

A window (so many consecutive bytes or words of one text) selects the smallest
hash of the grams it holds. Equal windows select equal hashes, so windows only
need to be compared where they select the same one. Consecutive windows with
the same choice are a unit; units stand for about as many windows as a window
holds grams, halved.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class PrefixHash:
    """Polynomial prefix hashes of a sequence of 64-bit values, modulo 2**64."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            terms = values * powers(_BASE, len(values))
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(_INVERSE, len(values) + 1)

    def runs(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` values, by start."""
        if len(self.prefix) <= size:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.prefix[size:] - self.prefix[:-size]) * self.back[: len(self.prefix) - size])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of values[start:stop] for arrays of bounds; its length is mixed in."""
        with np.errstate(over="ignore"):
            h = (self.prefix[stop] - self.prefix[start]) * self.back[start]
            return mix(h + (stop - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """min(h[i : i + size]) for every i, by doubling."""
    if len(h) < size:
        return h[:0]
    low, have = h, 1
    while 2 * have <= size:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < size:
        low = np.minimum(low[: len(h) - size + 1], low[size - have : size - have + len(h) - size + 1])
    return low


def units(values: np.ndarray, text: np.ndarray, window: int, gram: int):
    """Units of the windows of a batch of texts.

    ``values``: the texts' values, one text after another; ``text``: the text
    of each value (ascending). A window selects the rightmost of its smallest
    grams. Returns (choice, content, first, last, at, hashes): the hash
    selected, the hash of all values of the unit's windows, the first value of
    the first window and of the last, the first value of the selected gram -
    all windows of the unit hold it - and the PrefixHash.
    """
    hashes = PrefixHash(values)
    grams = hashes.runs(gram)
    z = np.zeros(0, np.int64)
    if len(grams) < window - gram + 1:
        return grams[:0], grams[:0], z, z, z, hashes
    # The low bits hold the place counted from the end, so that of equal hashes the rightmost is least.
    bits = max(1, len(grams).bit_length())
    low = np.uint64((1 << bits) - 1)
    ranked = (grams & ~low) | np.arange(len(grams) - 1, -1, -1, dtype=np.uint64)
    place = len(grams) - 1 - (sliding_min(ranked, window - gram + 1) & low).astype(np.int64)
    start = np.flatnonzero(text[: len(place)] == text[window - 1 :])  # windows within one text
    if not len(start):
        return grams[:0], grams[:0], z, z, z, hashes
    own = place[start]
    begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    first, last, at = start[begin], start[np.r_[begin[1:], len(start)] - 1], own[begin]
    return grams[at], hashes.spans(first, last + window), first, last, at, hashes
