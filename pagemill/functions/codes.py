"""Code points of Arrow's strings, and symbols of sequences that lie one after another."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken in one go.
PIECE = 1 << 23


def pieces(*texts: pa.Array, size: int = PIECE) -> Iterator[list[pa.Array]]:
    """Columns of equal length, cut to pieces of about ``size`` bytes; a longer row is a piece by itself."""
    n = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // size)) + 1
    for lo, hi in pairwise([0, *cuts.tolist(), len(n)]):
        yield [t.slice(lo, hi - lo) for t in texts]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings' code points one after another, and how many each has; null has none."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = t.buffers()
    at = np.frombuffer(at, np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    text = str(memoryview(data or b"")[at[0] : at[-1]], "utf-8")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32), pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64)


def of_points(points: np.ndarray) -> pa.Array:
    """A string for each code point; null where it is negative."""
    return pa.array([chr(x) if x >= 0 else None for x in points.tolist()], pa.string())


def places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the symbols of sequences lie, one sequence after another."""
    t = np.int32 if not len(n) or (at + n).max() < 1 << 31 else np.int64
    total = int(n.sum())
    return np.repeat((at - (np.cumsum(n) - n)).astype(t), n) + np.arange(total, dtype=t)


def tallied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of code points (-1: none) at equal places of both: the two, where they stand first, and how often."""
    low = 1 + max(int(a.max(initial=0)), int(b.max(initial=0)))
    known = np.zeros(low + 1, bool)
    known[a] = known[b] = True  # -1 is the last one
    kinds = np.flatnonzero(known)
    code = np.zeros(low + 1, np.int64)
    code[kinds] = np.arange(len(kinds))
    key = code[a] * len(kinds) + code[b]
    if len(kinds) <= 1024:
        count, first = np.bincount(key, minlength=len(kinds) ** 2), np.zeros(len(kinds) ** 2, np.int64)
        first[key[::-1]] = np.arange(len(key))[::-1]
        keys = np.flatnonzero(count)
        count, first = count[keys], first[keys]
    else:
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
    kinds = np.where(kinds == low, -1, kinds)
    return np.stack([kinds[keys // len(kinds)], kinds[keys % len(kinds)]]), first, count
