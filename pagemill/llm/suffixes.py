"""Hash-compared suffix sorting in numpy.

Suffixes are compared through prefix polynomial hashes: a binary search over
lengths finds their common extension in logarithmic time, and the next byte
decides.  The sort is a bottom-up mergesort over many independent segments at
once; an element's place in a merge is found by binary search in the other
run.  Equal neighbours are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix

_VALUE = np.random.default_rng(23).integers(1, 1 << 63, 256, np.int64).view(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        grow = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(2 * n, 1 << 20), x)]))
        _powers[:] = [grow(_STEP), grow(_BACK)]
    return _powers[0], _powers[1]


class Text:
    """Bytes with their prefix hashes modulo 2 ** 64."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.up, self.down = powers(len(data) + 1)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[self.bytes] * self.up[: len(data)])])

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        """Hash of the n bytes at each place."""
        return (self.prefix[at + n] - self.prefix[at]) * self.down[at]

    def names(self, at: np.ndarray, n) -> np.ndarray:
        return mix(self.hash(at, n)).view(np.int64)


def minimizers(text: Text, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-byte strings, and for each place the place of the least (first on ties) of the w strings from there on."""
    n = len(text.bytes) - k + 1
    if n < w:
        return np.zeros(max(n, 0), np.int64), np.zeros(0, np.int64)
    h = mix((text.prefix[k:] - text.prefix[:-k]) * text.down[:n])
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < w:
        key = np.minimum(key[: len(key) - (w - width)], key[w - width :])
    return h.view(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _less(text: Text, a: np.ndarray, b: np.ndarray, n: int, names_a: np.ndarray, names_b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a are less than those at b (or equal, where wanted)."""
    out = or_equal.copy()
    at = np.flatnonzero(names_a != names_b)
    x, y = a[at], b[at]
    common = np.zeros(len(at), np.int64)
    step = 1 << (n - 1).bit_length() - 1
    while step:
        try_ = common + step <= n - 1
        same = text.hash(x + common, np.where(try_, step, 0)) == text.hash(y + common, np.where(try_, step, 0))
        common += np.where(try_ & same, step, 0)
        step >>= 1
    out[at] = text.bytes[x + common] < text.bytes[y + common]
    return out


def sort_segments(text: Text, at: np.ndarray, n: int, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the n-byte strings at ``at`` within each segment (ascending numbers), and whether each equals the one before it there."""
    names = text.names(at, n)
    order = np.arange(len(at))
    if not len(at):
        return order, np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(begin, len(at)))
    width = 1
    while True:
        live = size > width
        if not live.any():
            break
        b, s = begin[live], size[live]
        where = np.repeat(b - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        base, length = np.repeat(b, s), np.repeat(s, s)
        q = where - base
        block = q // (2 * width) * (2 * width)
        right = q - block >= width
        lo = base + np.minimum(np.where(right, block, block + width), length)
        hi = base + np.minimum(np.where(right, block + width, block + 2 * width), length)
        first, mine = lo.copy(), order[where]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            other, own = order[mid], mine[open_]
            # A left element counts the lesser ones of the right run, a right element also the equal ones of the left run.
            less = _less(text, at[other], at[own], n, names[other], names[own], right[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        place = base + block + (q - block - np.where(right, width, 0)) + (lo - first)
        order[place] = mine
        width *= 2
    # Collision verification: neighbours' bytes must be in order, and tell whether they are equal.
    same = np.zeros(len(at), bool)
    view = np.lib.stride_tricks.sliding_window_view(text.bytes, n)
    met = np.flatnonzero(segment[order[1:]] == segment[order[:-1]]) + 1
    if (np.bincount(order, minlength=len(at)) != 1).any():
        return _sorted_plainly(text, at, n, segment)
    for i in range(0, len(met), 1 << 15):
        part = met[i : i + (1 << 15)]
        x, y = view[at[order[part - 1]]], view[at[order[part]]]
        differ = x != y
        first = differ.argmax(axis=1)
        rows = np.arange(len(part))
        same[part] = ~differ[rows, first]
        if (x[rows, first] > y[rows, first]).any() or (same[part] & (order[part - 1] > order[part])).any():
            return _sorted_plainly(text, at, n, segment)
    return order, same


def _sorted_plainly(text: Text, at: np.ndarray, n: int, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes collide: by the bytes themselves."""
    raw = text.bytes.tobytes()
    order = np.array(sorted(range(len(at)), key=lambda i: (segment[i], raw[at[i] : at[i] + n])), np.int64)
    same = np.zeros(len(at), bool)
    for i in range(1, len(at)):
        a, b = order[i - 1], order[i]
        same[i] = segment[a] == segment[b] and raw[at[a] : at[a] + n] == raw[at[b] : at[b] + n]
    return order, same
