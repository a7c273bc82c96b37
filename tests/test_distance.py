"""Distances of many pairs at once: exact, and without a Python step for each symbol of the longer line."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import codes
from pagemill.functions import distance as D
from pagemill.functions import text as T
from pagemill.operators import evaluate
from tests.test_whole import plain


def pair(rng):
    letters = rng.choice(["ab", "abcdé日🙂 ", "abcdefghijklmnopqrstuvwxyz "])
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    a = some(rng.choice([0, 1, 3, 10, 40, 64, 65, 90]))
    kinds = (a, a.replace("a", ""), "".join(x for x in a if rng.random() < 0.8), "".join(some(1) if rng.random() < 0.1 else x for x in a), "x " + a[1:42], some(rng.randrange(70)))
    return (a, rng.choice(kinds))[:: rng.choice([1, -1])]


@pytest.mark.parametrize("alone,go,masks", [(100, 1 << 20, 1 << 22), (1 << 40, 1 << 20, 200), (0, 1 << 20, 1 << 22), (100, 900, 1 << 22)])
def test_exact(monkeypatch, alone, go, masks):
    for k, v in (("_ALONE", alone), ("_GO", go), ("_MASKS", masks)):
        monkeypatch.setattr(D, k, v)
    rng = random.Random(3)
    a, b = zip(*(pair(rng) for _ in range(800)), strict=True)
    assert D.distances(*T._chars(pa.array(a), pa.array(b))).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_large_symbols():
    assert D.distance(np.array([1 << 40, 5, 7]), np.array([5, 1 << 41, 7])) == 2


def test_cost():
    """Before: a step in Python for each symbol of the longer line, 5 s for these."""
    rng = random.Random(1)
    a = ["".join(rng.choice("abcdefghij klmnopqrst") for _ in range(1000)) for _ in range(6000)]
    x = T._chars(pa.array(a), pa.array(["x " + s[1:42] for s in a]))
    began = time.process_time()
    D.distances(*x)
    assert time.process_time() - began < 1.5


def test_pieces():
    a, b = pa.array(["ab", None, "é", "c" * 50, ""]), pa.array(["", "x", None, "d", "e"])
    cut = list(codes.pieces(a, b, size=4))
    assert [x for p, _ in cut for x in p.to_pylist()] == a.to_pylist() and len(cut) > 2
    points, n = codes.code_points(a.slice(1, 3))
    assert n.tolist() == [0, 1, 50] and points.tolist() == [233] + [99] * 50


def test_null_lines(spark):
    d = spark.createDataFrame([(0, "abc", "axc"), (1, None, "a"), (2, "a", None), (3, "", "é日"), (4, "a b", "a")], "k int, a string, b string")
    got = d.select("k", T.levenshtein(F.col("a"), F.col("b")).alias("c"), T.word_edits(F.col("a"), F.col("b")).alias("w")).orderBy("k").collect()
    assert [(r.c, r.w) for r in got] == [(1, 1), (None, None), (None, None), (2, 1), (2, 1)]


def test_memory():
    """Bounds hold a slice's numbers at a time, not a batch's (16 MB here; 31 with slices of 1 << 20 symbols)."""
    a = ["word after word, " * 60] * 1500
    x = T._chars(pa.array(a), pa.array([s.replace(" ", "") for s in a]))
    tracemalloc.start()
    D.distances(*x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(x[k].nbytes for k in (0, 2))


def test_three_way(spark):
    rng = random.Random(9)
    rows = [(k % 7, k, v, a, pair(rng)[0]) for k, (v, a) in enumerate(pair(rng) for _ in range(400))]
    d = spark.createDataFrame(rows, "page long, seq long, v string, a string, b string").repartition(3)
    cer = lambda v, x: plain(v, x) / len(v) if v else float(x != "")
    (got,) = evaluate.three_way(d).collect()
    assert (got.n, got.a_exact, got.b_exact) == (400, sum(r[2] == r[3] for r in rows), sum(r[2] == r[4] for r in rows))
    assert [got.a_cer_sum, got.b_cer_sum] == pytest.approx([sum(cer(r[2], r[k]) for r in rows) for k in (3, 4)], abs=1e-5)
    pages = evaluate.three_way_pages(d).collect()
    assert len(pages) == 7 and sum(r.a_cer_sum for r in pages) == pytest.approx(got.a_cer_sum, abs=1e-4)
