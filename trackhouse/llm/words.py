"""Words of many texts at once: spans, word hashes and hashes of runs of words, in numpy.

Hashes are polynomials modulo 2**64 over random byte values, taken from prefix sums, so a whole
slice of texts costs a few passes over its bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20240607)
_VALUES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)

#: Bytes of words that white space parts: all but space and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse; tables grow in powers of two and are kept."""
    return _powers(base, 1 << max(16, int(n).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that every bit depends on all bits."""
    h = (h ^ (h >> _SHIFT)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _SHIFT)


def spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the number of the first of its words (one more
    entry at the end)."""
    inside = table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    ends[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(_BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of ``length`` words, over text borders too: the caller drops those."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * down[:n])


def run_starts(firsts: np.ndarray, length: int) -> np.ndarray:
    """For every word, whether a run of ``length`` words of the same text starts there."""
    fits = np.zeros(int(firsts[-1]) + 1, np.int32)
    counts = np.diff(firsts)
    has = counts >= length
    np.add.at(fits, firsts[:-1][has], 1)
    np.add.at(fits, (firsts[1:] - length + 1)[has], -1)
    return np.cumsum(fits[:-1]) > 0
