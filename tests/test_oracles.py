"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from seqspark.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    from seqspark.plans.fixtures import TABLES

    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def cell(x):
        return round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert len(ours) == len(theirs)
    for a, b in zip(plain(ours), plain(theirs), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
