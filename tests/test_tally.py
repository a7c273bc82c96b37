"""Characters at equal places are counted by batch, not as a row each."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from pagemill.operators import evaluate

ROWS = [(2, 1, "", ""), (1, 5, "ab", "ba"), (1, 3, "aé🙂", "aë🙃x"), (3, 0, "aaa", ""), (0, 7, "", "aa"), (1, None, "a", "b"), (4, 0, None, "b"), (4, 1, "b", None), (None, 2, "ca", "ac")]
SCHEMA = "page long, seq long, ref string, hyp string"


def data(many: bool):
    rng = random.Random(5)
    letters = "abcdåäö e🙂" + ("".join(map(chr, range(0x4E00, 0x4E00 + 1500))) if many else "")
    some = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
    return [*ROWS, *((rng.randrange(9), k, some(), some()) for k in range(300))]


def expected(rows, letters=None):
    n, first = Counter(), {}
    for page, seq, ref, hyp in rows:
        if ref is None or hyp is None:
            continue
        for i, x in enumerate(ref):
            y = hyp[i] if i < len(hyp) else None
            if (letters is None and y is not None and x != y) or (letters and x in letters):
                n[x, y] += 1
                at = (page is not None, page or 0, seq is not None, seq or 0, i)
                first[x, y] = min(first.get((x, y), at), at)
    return n, first


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("letters", [None, "aåb🙂"])
def test_counts(spark, many, letters):
    rows = data(many)
    got = evaluate._tally(spark.createDataFrame(rows, SCHEMA).repartition(3), letters).collect()
    n, first = expected(rows, letters)
    assert {(r.ref, r.hyp): r.n for r in got} == n
    assert {(r.ref, r.hyp): (r._first.page is not None, r._first.page or 0, r._first.seq is not None, r._first.seq or 0, r._first._i) for r in got} == first


@pytest.mark.parametrize("letters", [None, "aåb🙂"])
def test_pieces(letters):
    rows = data(True)
    t = pa.table([pa.array([r[k] for r in rows]) for k in range(4)], names=["page", "seq", "ref", "hyp"])
    n, first = expected(rows, letters)
    got, seen = Counter(), {}
    for b in evaluate._tallies(iter(t.to_batches(max_chunksize=100)), letters, size=64):
        for r in b.to_pylist():
            k, at = (r["ref"], r["hyp"]), (r["page"] is not None, r["page"] or 0, r["seq"] is not None, r["seq"] or 0, r["_i"])
            got[k] += r["n"]
            seen[k] = min(seen.get(k, at), at)
    assert (got, seen) == (n, first)


def test_top_and_plan(spark):
    rows = data(False)
    top = evaluate.confusions(spark.createDataFrame(rows, SCHEMA))
    n, first = expected(rows)
    assert [(r.true_char, r.pred_char, r.n) for r in top.collect()] == [(*k, n[k]) for k in sorted(n, key=lambda k: (-n[k], first[k]))[:20]]
    for d in (top, evaluate.diacritics(spark.createDataFrame(rows, SCHEMA)), evaluate.confusion_rates(spark.createDataFrame(rows, SCHEMA))):
        assert "Generate" not in d._jdf.queryExecution().toString()


def test_letters(spark):
    got = {r.letter: (r.total, r.correct) for r in evaluate.diacritics(spark.createDataFrame([(0, 0, "åäå", "åa"), (0, 1, "", "å")], SCHEMA)).collect()}
    assert got == {"å": (2, 1), "ä": (1, 0)}
