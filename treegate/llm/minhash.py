"""Similarity sketches for sets of 64-bit hashes, and their bands.

The sketch is the one of "Fast Similarity Sketching" (Dahlgaard, Knudsen, Thorup,
FOCS 2017): 2t rounds over t bins.  In the first t rounds every element falls in a
bin of its own hash; in round t + i every element falls in bin i, so every bin is
filled at the end.  A bin keeps the least (round, value); rounds stop as soon as no
bin is empty, so a set of n elements costs O(n + t log t) in expectation, and the
number of bins in which two sketches agree is concentrated as for t independent
hashes.
"""

from __future__ import annotations

import numpy as np

from treegate.llm.kernels import mix

_EMPTY = np.uint64(2**64 - 1)
_VALUE_BITS = 48


class FastSimilaritySketch:
    """t bins (a power of two, 256 at most: round numbers use 9 bits)."""

    def __init__(self, bins: int = 128, seed: int = 7):
        if bins & (bins - 1) or not 2 <= bins <= 256:
            raise ValueError("bins: a power of two from 2 to 256")
        self.bins = bins
        self.bits = bins.bit_length() - 1
        self.seeds = mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """x: distinct uint64, at least one. Returns ``bins`` uint64: round << 48 | value."""
        t, out = self.bins, np.full(self.bins, _EMPTY)
        r, block = 0, max(1, 1024 // len(x))
        while r < t:
            rounds = np.arange(r, min(t, r + block))
            h = mix(x[None, :] ^ self.seeds[rounds][:, None])
            key = (h >> np.uint64(64 - _VALUE_BITS - 7)) >> np.uint64(7)
            key |= rounds.astype(np.uint64)[:, None] << np.uint64(_VALUE_BITS)
            np.minimum.at(out, (h & np.uint64(t - 1)).astype(np.intp).ravel(), key.ravel())
            r += len(rounds)
            if out.max() != _EMPTY:
                return out
        for i in np.flatnonzero(out == _EMPTY):
            h = mix(x ^ self.seeds[t + i])
            out[i] = (h >> np.uint64(64 - _VALUE_BITS)).min() | np.uint64(t + i) << np.uint64(_VALUE_BITS)
        return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One uint64 per band of ``rows`` neighbouring bins; the band's number is hashed in."""
    bands = len(sketch) // rows
    part = sketch[: bands * rows].reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(rows):
        h = mix(h ^ part[:, j])
    return h
