"""Hashes of all words of a text at once, without a Python object a word."""

from __future__ import annotations

import numpy as np

_SPAN = 32
_MIX = np.random.default_rng(20).integers(0, 1 << 64, (256 * _SPAN,), np.uint64)


def runs(kinds: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal kinds."""
    if not kinds.size:
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1))


def run_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes that begins at a start and ends before the next."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    h = np.add.reduceat(_MIX[data.astype(np.int64) * _SPAN + (within & (_SPAN - 1))], starts)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
