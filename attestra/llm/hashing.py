"""Rolling hashes over code points, vectorised: prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(which: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have), 1 << 14), (BASE, _INVERSE)[which], np.uint64)
        step[0] = 1
        have = _powers[which] = np.cumprod(step, dtype=np.uint64)
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another for each seed."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Hashes of any stretch of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(0x51)) * _grown(0, n)[:n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """The hash of each run of ``k`` code points, by start."""
        if self.n < k:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * _grown(1, self.n)[: self.n - k + 1])

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _grown(1, self.n + 1)[starts])


_PLACE = (1 << 24) - 1


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest value of every run of ``w`` values, ascending and distinct.

    Values are compared by their upper 40 bits; of equal ones the last counts. So a run's
    position depends on nothing but the run, wherever it stands.
    """
    n = len(h)
    if n < w or not n:
        return np.empty(0, np.int64)
    if n > _PLACE:  # places within a part fit beside the values
        step = _PLACE - w
        return np.unique(np.concatenate([window_minima(h[i : i + step + w - 1], w) + i for i in range(0, n - w + 1, step)]))
    # Runs are covered by the suffix of one block and the prefix of the next.
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (h & np.uint64(~_PLACE & ((1 << 64) - 1))) | np.arange(_PLACE, _PLACE - n, -1, dtype=np.uint64)
    grid = padded.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[: n - w + 1], before[w - 1 : n])
    places = _PLACE - (low & np.uint64(_PLACE)).astype(np.int64)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]
