"""64-bit hashes of words and of word shingles, for whole texts at once."""

from __future__ import annotations

import numpy as np

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x9E3779B97F4A7C55


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P1
    h = (h ^ (h >> np.uint64(29))) * _P2
    return h ^ (h >> np.uint64(32))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            step = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)


def word_hashes(b: np.ndarray, solid: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text (its bytes ``b``): runs of ``solid``, by differences of one running
    polynomial hash."""
    powers.grow(len(b) + 1)
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * powers.up[: len(b)], out=run[1:])
    return start, end, mix((run[end] - run[start]) * powers.down[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    factors = mix(np.arange(1001, 1001 + size, dtype=np.uint64)) | np.uint64(1)
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        out += h[i : len(h) - size + 1 + i] * factors[i]
    return mix(out)
