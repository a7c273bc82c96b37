"""Sets of five-word shingles, MinHash samples and odd sketches, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .hashing import mix, string_hashes

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bins of the one-permutation samples behind an odd sketch, and the sketch's bits.
BINS, SKETCH = 1024, 2048

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(17)
_MUL = (_rng.integers(0, 1 << 62, SAMPLES, np.int64).view(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, SAMPLES, np.int64).view(np.uint64)
_PLACE = [np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64)) for j in range(WORDS)]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, one text after the other; and how many each has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    w = string_hashes(_FOLD[data], start, end)
    stop = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.concatenate([[0], np.searchsorted(start, stop)]))
    first = np.cumsum(n) - n
    # Windows of five words that lie in one text; a shorter text is one window of all its words.
    size = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(texts)), size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    padded = np.concatenate([w, np.zeros(WORDS, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    left = (first + n)[doc]
    for j in range(WORDS):
        h += np.where(at + j < left, padded[at + j], np.uint64(0)) * _PLACE[j]
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(texts))


def set_names(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set: equal sets, equal names."""
    stop = np.cumsum(n).tolist()
    raw = h.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * (b - k) : 8 * b]) for b, k in zip(stop, n.tolist(), strict=True)]


def samples(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """MinHash samples, uint32, sets x SAMPLES; zeros for empty sets."""
    out = np.zeros((len(n), SAMPLES), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        for k in range(SAMPLES):
            out[full, k] = np.minimum.reduceat(((h * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """int64 keys, sets x BANDS; the band's number is part of the key."""
    h = np.zeros((len(s), BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, j::ROWS].astype(np.uint64) + np.uint64(1))
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def odd_sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 words, sets x SKETCH / 64, and the number of samples behind each.

    The samples are one-permutation MinHash: of the shingles that fall into a
    bin the least.  Bit b is the parity of the number of samples hashed to b.
    """
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    g = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    cell = doc * BINS + (g & np.uint64(BINS - 1)).astype(np.int64)
    order = np.lexsort((g, cell))
    first = np.ones(len(order), bool)
    first[1:] = cell[order[1:]] != cell[order[:-1]]
    pick = order[first]
    bit = (mix(g[pick]) >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)
    odd = np.bincount(doc[pick] * SKETCH + bit, minlength=len(n) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(len(n), SKETCH // 64), np.bincount(doc[pick], minlength=len(n))


def similarity(a, ka, na, b, kb, nb) -> np.ndarray:
    """Estimated Jaccard similarity from sketches, their numbers of samples and the sets' sizes (broadcast against each other).

    The population count of the sketches' XOR tells how many samples are in one
    only, and so how many bins agree.  Of the bins that both sets fill, those
    that don't agree are taken at their expected number, which depends on the
    similarity: a fixed point, approached by halves.  The bins that the union
    fills then follow from the actual numbers of samples; their expected number
    would do for large sets only.
    """
    odd = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    differ = -SKETCH / 2 * np.log(np.maximum(1 - 2 * odd / SKETCH, 1e-9))
    agree = np.maximum(ka + kb - differ, 0) / 2
    both_or_less = 1 - np.exp(-na / BINS) - np.exp(-nb / BINS)
    j = np.full(odd.shape, 0.75)
    for _ in range(8):
        none = np.exp(-(na + nb) / (1 + j) / BINS)
        apart = np.maximum(BINS * (both_or_less + none - j * (1 - none)), 0)
        j = (j + np.clip(agree / np.maximum(ka + kb - agree - apart, 1), 0, 1)) / 2
    return j
