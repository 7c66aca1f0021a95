"""Vectorised hashes of words and of word windows, over UTF-8 bytes.

A word's hash is a polynomial of random byte values modulo 2**64 whose base is odd, taken from one running sum over the
bytes and moved to position 0 by the base's inverse; a window's hash is the same over words. Equal words and windows have
equal hashes wherever they stand; different ones of equal shape differ unless 64 random bits agree.
"""

from __future__ import annotations

import re

import numpy as np

CHUNK = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MASK = (1 << 64) - 1


def _base(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) * 2 + 1 & _MASK


class _Powers:
    def __init__(self, seed: int):
        self.base = _base(seed)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, pow(self.base, -1, 1 << 64), np.uint64))])
        return self.up, self.down


_BYTES, _FIRST, _SECOND = _Powers(11), _Powers(12), _Powers(13)
_TABLE = np.random.default_rng(14).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[list(_SPACES)] = 0
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(raw: bytes):
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            m = _SPACE.search(raw, end)  # a word stays whole
            end = m.start() if m else n
        yield at, end
        at = end


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word."""
    out = []
    for a, b in _chunks(raw):
        x = np.frombuffer(raw, np.uint8, b - a, a)
        n = len(x)
        edge = np.diff(~_IS_SPACE[x], prepend=False, append=False)  # true where a word begins or ends
        edge = np.flatnonzero(edge)
        starts, ends = edge[::2], edge[1::2]
        up, down = _BYTES.get(n)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[x] * up[:n], out=c[1:])
        h = (c[ends] - c[starts]) * down[starts]
        out.append((mixed(h + (ends - starts).astype(np.uint64)), starts + a, ends + a))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of every window of k hashes; `second` gives an independent one."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = (_SECOND if second else _FIRST).get(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((mixed(h + np.uint64(77)) if second else h) * up[:n], out=c[1:])
    return mixed((c[k:] - c[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours."""
    if len(x) < k:
        return x[:0]
    span = 1
    y = x
    while 2 * span <= k:
        y = np.minimum(y[: len(y) - span], y[span:])
        span *= 2
    rest = k - span
    return np.minimum(y[: len(y) - rest], y[rest:]) if rest else y
