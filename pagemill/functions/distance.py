"""Exact Levenshtein distances of integer sequences of any length, many pairs at once."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from pagemill.functions.codes import places

#: Symbols that are looked at in one go, entries of a table of masks, and kinds of symbols that bounds tell apart (a power of two).
_GO, _MASKS, _KINDS = 1 << 18, 1 << 22, 128
#: Rough microseconds: a pair by itself, and a step of all pairs side by side.
_ALONE, _STEP = 100, 20


def distance(a: np.ndarray, b: np.ndarray) -> int:
    return int(distances(a, np.array([len(a)]), b, np.array([len(b)]))[0])


def distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of the sequences that lie one after another in ``a`` and in ``b``, ``n`` and ``m`` symbols (not negative) long.

    Equal ends are cut off; where a lower and an upper bound meet, that is the distance; else the bit-parallel table decides.
    """
    flat = np.concatenate([a, b])
    if len(flat) and flat.max() >= 1 << 21:
        flat = np.unique(flat, return_inverse=True)[1]
    at, to, swap = np.cumsum(n) - n, len(a) + np.cumsum(m) - m, n > m
    at, to, n, m = np.where(swap, to, at), np.where(swap, at, to), np.minimum(n, m), np.maximum(n, m)
    out = np.zeros(len(n), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(n + m + _KINDS) // _GO)) + 1
    left = [_bounds(flat, out, np.arange(*z), at, n, to, m) for z in pairwise([0, *cuts.tolist(), len(n)])]
    rows, at, n, to, m = (np.concatenate(x) for x in zip(*left, strict=True))
    beside = np.flatnonzero(n <= 64)
    beside = beside[np.argsort(-m[beside], kind="stable")]
    beside = beside[np.argmin(_ALONE * np.arange(len(beside) + 1) + _STEP * np.append(m[beside], 0)) :]
    if len(beside):
        out[rows[beside]] = _tables(flat, at[beside], n[beside], to[beside], m[beside])
    for k in np.setdiff1d(np.arange(len(rows)), beside, assume_unique=True):
        x, y = flat[at[k] : at[k] + n[k]], flat[to[k] : to[k] + m[k]]
        out[rows[k]] = m[k] - n[k] if _within(x, y) else _table(x, y)
    return out


def _bounds(flat, out, rows, at, n, to, m) -> tuple[np.ndarray, ...]:
    """Set ``out`` where bounds decide; the other rows, without equal ends: row, begin and length of the shorter and of the longer one."""
    at, n, to, m = at[rows], n[rows], to[rows], m[rows]
    out[rows] = m - n
    end = np.cumsum(n)
    wrong = np.flatnonzero(flat[places(at, n)] != flat[places(to, n)])
    first, last = np.searchsorted(wrong, end - n), np.searchsorted(wrong, end)
    head = np.minimum(np.append(wrong, end[-1:])[first] - (end - n), n)
    unequal = np.where(n == m, last - first, -1)
    out[rows[unequal == 1]] = 1
    k = np.flatnonzero((head < n) & (unequal != 1))
    rows, at, n, to, m, unequal = rows[k], at[k] + head[k], n[k] - head[k], to[k] + head[k], m[k] - head[k], unequal[k]

    end = np.cumsum(n)
    wrong = np.flatnonzero(flat[places(at, n)] != flat[places(to + m - n, n)])
    tail = np.minimum(end - 1 - np.insert(wrong, 0, -1)[np.searchsorted(wrong, end)], n)
    k = np.flatnonzero(tail < n)
    rows, at, n, to, m, unequal = rows[k], at[k], n[k] - tail[k], to[k], m[k] - tail[k], unequal[k]

    # The surplus of symbols, of kinds at least: an edit takes away one at most.
    of_a, of_b = flat[places(at, n)], flat[places(to, m)]
    kind = np.arange(len(rows)) * _KINDS
    kind_a, kind_b = np.repeat(kind, n) + (of_a & _KINDS - 1), np.repeat(kind, m) + (of_b & _KINDS - 1)
    in_a = np.bincount(kind_a, minlength=len(rows) * _KINDS)
    more = (np.bincount(kind_b, minlength=len(rows) * _KINDS) - in_a).reshape(-1, _KINDS)
    over = np.maximum(more, 0).sum(1)
    low = np.maximum(over, over - more.sum(1))
    met = unequal == low
    out[rows[met]] = low[met]

    # The longer one without the kinds that the shorter one lacks: if it is the shorter one, the rest was deleted.
    lost = np.where(in_a.reshape(-1, _KINDS) > 0, 0, more).sum(1)
    may = (lost == m - n) & ~met
    of_a, of_b = of_a[np.repeat(may, n)], of_b[(in_a > 0)[kind_b] & np.repeat(may, m)]
    wrong = np.flatnonzero(of_a != of_b)
    row = np.flatnonzero(may)
    may[row[np.searchsorted(np.cumsum(n[row]), wrong, "right")]] = False
    k = np.flatnonzero(~met & ~may)
    return rows[k], at[k], n[k], to[k], m[k]


def _within(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a is what is left of b when symbols are deleted."""
    rest = iter(b.tolist())
    return all(x in rest for x in a.tolist())


def _table(a: np.ndarray, b: np.ndarray) -> int:
    """Myers' algorithm in Hyyrö's form: a column of the table, one for each symbol of a, is two integers of len(b) bits."""
    at = {x: int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little") for x in set(a.tolist())}
    full, top, score = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down = full, 0
    for x in a.tolist():
        eq = at[x]
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1 | 1) & full
        v = eq | down
        up, down = (less << 1 | ~(v | more)) & full, more & v
    return score


def _tables(flat, at, n, to, m) -> np.ndarray:
    """The same of many pairs side by side, the longest first: 64 symbols at most are the bits of a number, the others' symbols the steps."""
    known = np.unique(flat[places(at, n)])
    code = np.zeros(int(flat.max()) + 1, np.int64)
    code[known] = np.arange(1, len(known) + 1)
    wide, score = len(known) + 1, n.copy()
    for lo in range(0, len(n), max(1, _MASKS // wide)):
        z = slice(lo, lo + max(1, _MASKS // wide))
        score[z] = _block(flat, code, wide, at[z], n[z], to[z], m[z])
    return score


def _block(flat, code, wide, at, n, to, m) -> np.ndarray:
    one = np.uint64(1)
    base = np.arange(len(n)) * wide
    masks = np.zeros(len(n) * wide, np.uint64)
    np.bitwise_or.at(masks, np.repeat(base, n) + code[flat[places(at, n)]], one << places(0 * n, n).astype(np.uint64))
    top = (n - 1).astype(np.uint64)
    up, down, score = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64), n.copy()
    for j, k in enumerate(np.searchsorted(-m, -np.arange(int(m[0])), "left").tolist()):
        up, down = up[:k], down[:k]
        eq = masks[base[:k] + code[flat[to[:k] + j]]]
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up), up & h
        score[:k] += (more >> top[:k] & one).astype(np.int64) - (less >> top[:k] & one).astype(np.int64)
        more = more << one | one
        v = eq | down
        up, down = less << one | ~(v | more), more & v
    return score
