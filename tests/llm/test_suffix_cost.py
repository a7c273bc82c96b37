"""What the suffix sort is spared: copies and windows of their own."""

import random

import pyarrow as pa

from pagemill.llm import suffix_dedup


def test_suffix_sort_leaves_copies_out(monkeypatch):
    """However many copies and other surroundings meet under an anchor, only windows that may be equal are sorted."""
    rng = random.Random(5)
    anchor, sorted_ = "and so it goes on and on", []
    one = "".join(rng.choices("abcdefgh", k=76)) + anchor + "".join(rng.choices("abcdefgh", k=76))
    late = one[:150] + "".join(rng.choices("xyz", k=26))  # its first windows are those of ``one``

    def settled(texts, runs):
        t = [(1, 0, runs, 0, 24, 10 * i, 0, 77 if len(x) > 100 else 1, 76 if len(x) > 100 else 50, x.encode()) for i, x in enumerate(texts)]
        names = ["h", "run", "runs", "lo", "hi", "doc", "start", "n", "back", "bytes"]
        table = pa.table([pa.array(c, suffix_dedup._TYPES[x]) for x, c in zip(names, zip(*t, strict=True), strict=True)], names)
        sorted_.clear()
        out = [r for b in suffix_dedup._by_suffix(table, 100) for r in b.to_pylist()]
        return {(r["doc"], r["start"], r["n"]) for r in out if r["kind"] == 2}, [r["doc"] for r in out if r["kind"] == 0]

    real = suffix_dedup.sort_segments
    monkeypatch.setattr(suffix_dedup, "sort_segments", lambda text, at, *more: sorted_.append(len(at)) or real(text, at, *more))
    others = ["".join(rng.choices("abcdefgh", k=50)) + anchor + "".join(rng.choices("abcdefgh", k=26)) for _ in range(30)]
    for copies in (20, 60):
        texts = [one] * copies + others + [late]
        gone, on = settled(texts, 1)
        assert gone == {(10 * i, 0, 176) for i in range(1, copies)} | {(10 * (copies + 30), 0, 150)} and not on
        assert sum(sorted_) == 2 * 51  # the windows that ``one`` and ``late`` share
        assert settled(texts, 2)[0] == gone
        assert set(settled(texts, 2)[1]) == {0, *range(10 * copies, 10 * (copies + 31), 10)}
