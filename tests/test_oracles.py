"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from pagemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "conversations documents embeddings events benchmark labels pages".split()


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracles()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(norm(v) for v in r) for r in want.fetchall()]
    mine = [tuple(norm(v) for v in r) for r in got.select(*names).collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, rows))


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracles())):
        assert registry.queries()[name](spark, SF).count() >= 0, name
