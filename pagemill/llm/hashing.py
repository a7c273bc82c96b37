"""64-bit hashes of strings inside a byte array, for all strings at once.

A string is read as 8-byte chunks; each chunk is mixed together with its
number before the chunks are added up.  Unlike a polynomial modulo 2 ** 64,
whose values agree on Thue-Morse words and their complements whatever the
base, this has no systematic collisions.
"""

from __future__ import annotations

import numpy as np

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NTH, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def chunks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every string's bytes as 8-byte numbers padded with zeros, one string after the other, and each string's number of them (one at least)."""
    n = np.maximum((size + 7) >> 3, 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, np.dtype("<u8"), buffer=padded, strides=(1,))
    if len(n) == int(n.sum()):
        return wide[start] & _MASK[np.minimum(size, 8)], n
    k = _numbers(n)
    return wide[np.repeat(start, n) + 8 * k] & _MASK[np.minimum(np.repeat(size, n) - 8 * k, 8)], n


def _numbers(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def hashes(chunk: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """uint64 hash of each string from its chunks and its size."""
    if not len(n):
        return np.zeros(0, np.uint64)
    if len(n) == len(chunk):
        total = mix(chunk + _NTH)
    else:
        total = np.add.reduceat(mix(chunk + (_numbers(n) + 1).astype(np.uint64) * _NTH), np.cumsum(n) - n)
    return mix(total + size.astype(np.uint64) * _SIZE)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return hashes(*chunks(data, start, end - start), end - start)
