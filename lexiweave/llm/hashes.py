"""Hashes of stretches of an array, all at once: polynomials modulo 2**64 by running sums."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as was asked for."""

    def __init__(self, base: np.uint64):
        self.bases = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in self.bases)
        return self.up[:n], self.down[:n]


_powers: dict[int, _Powers] = {}


def prefix(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values times rising powers, and the falling powers: (total[b] - total[a]) * down[a] depends on values[a:b] alone."""
    powers = _powers.setdefault(int(base), _Powers(base))
    up, down = powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a whole text (or its UTF-8), in order."""
    data = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    total, down = prefix(_TABLE[data], _BASE)
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total, down = prefix(words, _WORD_BASE)
    return mixed((total[size:] - total[:-size]) * down[: len(words) - size + 1])
