"""Words and word shingles of whole texts, hashed with numpy."""

from __future__ import annotations

import re

import numpy as np

#: Words are runs of bytes other than these white-space characters (fixed by the contract).
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return _mix(np.arange(256, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


_BYTES = _table(0x5851F42D4C957F2D)


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, the rest as it is."""
    return text.translate(_LOWER)


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            powers = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b & _MASK, np.uint64)]))
            self.up, self.down = powers(_ODD), powers(pow(_ODD, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text that isn't empty begins and ends."""
    inside = ~_SPACES[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0] * bool(inside[0]), edge, [len(inside)] * bool(inside[-1])]).astype(np.int64)
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    begin, end = word_bounds(text)
    up, down = _POWERS.of(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up, dtype=np.uint64)])
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of `size` words, sorted; all words as one run if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = words[: n - size + 1].copy()
    for k in range(1, size):
        h = _mix(h * np.uint64(_ODD)) + words[k : n - size + 1 + k]
    return np.unique(_mix(h))


def shingle_set(text: bytes, size: int) -> set[bytes]:
    """The same shingles as strings, for exact comparison."""
    words = WORD.findall(lowered(text))
    size = min(size, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
