"""Ranks by means don't depend on the order in which rows are added: equal means are ties, which go by key."""

import math
import random

import duckdb
import pytest

from seqspark.plans import catalog
from seqspark.plans.fixtures import fixture

SCHEMA = "l_partkey long, l_quantity double, l_discount double"


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """60 parts of the same 24 discounts and three of other numbers of rows but the same mean, in random order; five parts of a larger mean."""
    rng = random.Random(3)
    same = [rng.randrange(6) for _ in range(23)]
    same.append(72 - sum(same))  # 72 hundredths in 24 rows: a mean of 0.03
    rows = [(part, float(rng.randrange(1, 51)), d / 100) for part in range(100, 160) for d in same]
    for part, n in ((90, 23), (91, 21), (170, 25)):
        rows += [(part, 7.0, d / 100) for d in [3] * (n - 14) + [1, 5, 2, 4, 0, 6, 1, 5, 2, 4, 0, 6, 2, 4]]
    rows += [(part, 9.0, 0.04) for part in range(5) for _ in range(9)]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("tied"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.fixture(scope="module")
def exact(tied):
    """DuckDB over the same rows as decimals, whose sums are exact."""
    c = duckdb.connect()
    c.execute(f"create view lineitem as select l_partkey, l_quantity::decimal(12,2) l_quantity, l_discount::decimal(12,2) l_discount from '{tied}/lineitem.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["w02_leaderboard_by_objective", "w05_parents_by_objective"])
def test_ties_go_by_key(spark, tied, exact, name):
    df = catalog.queries()[name](spark, tied)
    ours = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    found = exact.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert ours == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())


def test_least_keys_of_equal_means(spark, tied):
    rows = catalog.queries()["w02_leaderboard_by_objective"](spark, tied).where("obj = 'obj2'").orderBy("rank").collect()
    assert [(r["rank"], r.seq_id, r.value) for r in rows] == [(i + 1, k, 0.03) for i, k in enumerate([90, 91, *range(100, 108)])]


def test_means_of_odd_numbers(spark, tmp_path):
    """Numbers that are no whole millionths, too large or missing leave the plain mean."""
    odd = {
        1: [math.nan, 0.1], 2: [math.inf, 0.1], 3: [-math.inf, math.inf], 4: [1e300, 0.01], 5: [1 / 3, 0.1], 6: [1e-12, 3e-12], 7: [None, None],
        8: [None, 0.05, 0.07], 9: [-0.01, 0.01], 10: [-0.0], 11: [999999999.0] * 10000, 12: [1e9, 2e9], 13: [0.000001, 0.000002], 14: [0.1234567, 0.1],
    }
    spark.createDataFrame([(k, x, x) for k, v in odd.items() for x in v], SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    for r in fixture(spark, str(tmp_path), "predictions_multi").collect():
        known = [x for x in odd[r.seq_id] if x is not None]
        if not known:
            assert r.mean is None
        else:
            plain = sum(known) / len(known)
            assert (math.isnan(plain) and math.isnan(r.mean)) or r.mean == pytest.approx(plain, rel=1e-14, abs=0), (r, plain)
