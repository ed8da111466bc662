"""First rows and ranks of whole tables against a plain sort, with many ties and narrow limits."""

import random

import pytest

from seqspark.operators import order

KEYS = (("score", False), ("name", True))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(rng.choice([None, float("nan"), -1.5, 0.0, 2.0, rng.gauss(0, 5)]), rng.choice([None, "", "A", "AA", "AAB", "zz", "é", "S%05d" % rng.randrange(500)]), i, rng.choice([3, 2**62 + rng.randrange(5), -(2**61)])) for i in range(3000)]
    return spark.createDataFrame(made, "score double, name string, id long, big long").repartition(7).cache()


def plain(row):
    known = row.score is not None and row.score == row.score
    return (not known, -row.score if known else 0, row.name is None, row.name or "", row.id)


@pytest.mark.parametrize("small", [5, 200, 10_000])
@pytest.mark.parametrize("k", [0, 1, 700, 1500, 2400, 2999, 3000, 4000])
def test_first_rows(rows, monkeypatch, small, k):
    monkeypatch.setattr(order, "SMALL", small)
    whole = sorted(rows.collect(), key=plain)
    assert sorted(r.id for r in order.first_rows(rows, k, *KEYS, ("id", True)).collect()) == sorted(r.id for r in whole[:k])
    alike = order.first_rows(rows, k, *KEYS).collect()
    assert [plain(r)[:4] for r in sorted(alike, key=plain)] == [plain(r)[:4] for r in whole[:k]]


def test_numbers_beyond_doubles(rows, monkeypatch):
    monkeypatch.setattr(order, "SMALL", 3)
    whole = sorted((r.big, r.id) for r in rows.collect())
    for k in (900, 1000, 2500):
        assert sorted((r.big, r.id) for r in order.first_rows(rows, k, ("big", True), ("id", True)).collect()) == whole[:k]


def test_ranks(spark, rows, tmp_path):
    got = order.ranked(rows, f"file://{tmp_path}/ranked", *KEYS, ("id", True)).collect()
    assert {r.id: r["rank"] for r in got} == {r.id: i + 1 for i, r in enumerate(sorted(rows.collect(), key=plain))}
    assert order.ranked(rows.limit(0), f"file://{tmp_path}/none", *KEYS).count() == 0
