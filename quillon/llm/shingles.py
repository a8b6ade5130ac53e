"""Word shingles as sorted 64-bit hashes, and minima of universal hash functions over them."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Columns of the minima's working matrix.
_BLOCK = 2048


def words(text: str | None) -> list[bytes]:
    """The words between white space (space, tab to carriage return), A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, ws)), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M2
    return x ^ (x >> _S29)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-word window in order; of the whole sequence if it is shorter."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    acc = mix(h[: n - width + 1])
    for j in range(1, width):
        acc = mix(acc * _M1 + h[j : n - width + 1 + j])
    return acc


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(windows(word_hashes(words(text)), k))


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of n multiply-add hash functions modulo 2^64."""
    g = np.random.default_rng(seed)
    return g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(xs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that isn't empty."""
    least = None
    for at in range(0, len(xs), _BLOCK):
        now = (xs[None, at : at + _BLOCK] * a[:, None] + b[:, None]).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    return least


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
