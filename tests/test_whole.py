"""Queries on lines see every line of every document, of any length and in any script.

Over a small table of long documents in several scripts, so that a cut would
show; distances are taken by the whole table.
"""

import random

import duckdb
import numpy as np
import pytest

from pagemill.functions.distance import distance
from pagemill.plans import registry
from pagemill.plans import views as V
from tests.test_oracles import norm

LINES, PAIRS = "lines AS (", "pairs AS ("
WORDS = "Report 1 2 3 total ELSE better Tree 45  66 value, seen (12) Apple order".split(" ")
DOCS = [(p, "\n".join("" if k % 13 == 5 else " ".join(WORDS[(p + k * j) % len(WORDS)] for j in range(1 + (p + k) % 6)) for k in range(n))) for p, n in ((1, 3), (2, 47), (3, 95), (7, 41), (8, 40))]


ACCENTS = ["Größe äöü ÄÖÜ ß Ähre", "été déjà vu 1 2 3 çà Élan", "mañana año ¿qué? Ñandú", "blåbær Øl Ærlig", "  " + "Lange Zeile mit Wörtern 12 34 und Ende. " * 9, "A plain line of over two hundred letters " * 8, "日本語 and 🙂 signs e"]
DOCS.append((4, "\n".join(ACCENTS * 7)))


def plain(a, b) -> int:
    """Levenshtein distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def whole(sql: str) -> str:
    assert LINES in sql and "i < " not in sql
    return sql.replace("levenshtein(", "plain(")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(p, t, "de", "web", len(t)) for p, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    known: dict = {}
    con.create_function("plain", lambda a, b: known[a, b] if (a, b) in known else known.setdefault((a, b), plain(a, b)), ["VARCHAR", "VARCHAR"], "BIGINT")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    return at, con


def rows(spark, docs, name, sql):
    at, con = docs
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    mine = [tuple(norm(v) for v in r) for r in registry.queries()[name](spark, at).select(*names).collect()]
    return sorted(map(repr, mine)), sorted(repr(tuple(norm(v) for v in r)) for r in want.fetchall())


def test_all_lines(spark, docs):
    got = {(r.page, r.seq): r.line for r in V.lines(spark, docs[0]).collect()}
    assert got == {(p, k): s for p, t in DOCS for k, s in enumerate(t.split("\n")) if s.strip(" ")}


@pytest.mark.parametrize("name", sorted(k for k, sql in registry.oracles().items() if LINES in sql and PAIRS not in sql))
def test_lines(spark, docs, name):
    mine, want = rows(spark, docs, name, whole(registry.oracles()[name]))
    assert mine == want


@pytest.mark.parametrize("name", sorted(k for k, sql in registry.oracles().items() if PAIRS in sql))
def test_pairs(spark, docs, name):
    mine, want = rows(spark, docs, name, whole(registry.oracles()[name]))
    assert mine == want


def test_all_pairs(spark, docs):
    assert V.pairs(spark, docs[0]).count() == V.lines(spark, docs[0]).count()


def test_wer(spark, docs):
    p = V.pairs(spark, docs[0]).collect()
    (got,) = registry.queries()["wer_micro"](spark, docs[0]).collect()
    assert (got.edits, got.ref_words) == (sum(plain(r.ref.split(), r.hyp.split()) for r in p), sum(len(r.ref.split()) for r in p))


def test_distance():
    rng = random.Random(7)
    for _ in range(3000):
        a, b = ([rng.choice([1, 2, 3, 70_000]) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        b = b if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        assert distance(np.array(a, np.int64), np.array(b, np.int64)) == plain(a, b), (a, b)
    for _ in range(20):
        a = [rng.randrange(5) for _ in range(200)]
        b = [x if rng.random() < 0.8 else rng.randrange(6) for x in a if rng.random() < 0.9]
        assert distance(np.array(a, np.int64), np.array(b, np.int64)) == plain(a, b)
