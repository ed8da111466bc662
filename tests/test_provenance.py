"""First places of sequences: nulls and ids of every size, and one reading of the tiles for j19_provenance."""

import pytest

from seqspark.operators import overlap
from seqspark.plans import catalog

LOW, HIGH = -(2**31), 2**31 - 1
IDS = [None, 0, 1, -1, 7, 2**30 - 1, 2**30, -(2**30), -(2**30) - 1, 2**40, -(2**40), 2**63 - 1, -(2**63)]
STARTS = [None, 0, 5, LOW, HIGH]


def plain(rows):
    order = lambda r: [(x is None, x if x is not None else 0) for x in r[1:]]
    return {s: min((r for r in rows if r[0] == s), key=order)[1:] for s in {r[0] for r in rows}}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_first_places_with_nulls_and_large_ids(spark, kind):
    places = [(i, s) for i in IDS for s in STARTS]
    rows = [(f"S{k}", *p) for k, p in enumerate(places)] + [(f"P{i}-{j}", *p) for i in range(len(places)) for j in range(0, len(places), 3) for p in (places[i], places[j])]
    if kind == "string":
        rows = [(a, None if b is None else f"id{b}", c) for a, b, c in rows]
    peptides = spark.createDataFrame(rows, f"sequence string, protein_id {kind}, start_pos int")
    found = overlap.first_places(peptides)
    assert found.schema.simpleString() == f"struct<sequence:string,protein_id:{kind},start_pos:int>"
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == plain(rows)


def test_provenance_keeps_all_scores(spark):
    scores = spark.createDataFrame([("AC", 1), ("AC", 2), ("no", 3), (None, 4)], "sequence string, n int")
    peptides = spark.createDataFrame([("AC", None, 3), ("AC", 9, 8), ("AC", 9, 2), (None, 1, 1), ("GG", 1, 1)], "sequence string, protein_id bigint, start_pos int")
    assert {tuple(r) for r in overlap.with_provenance(scores, peptides).collect()} == {("AC", 1, 9, 2), ("AC", 2, 9, 2), ("no", 3, None, None), (None, 4, None, None)}


def test_j19_cuts_tiles_once_and_sorts_none_to_aggregate(spark):
    df = catalog.queries()["j19_provenance"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan
    assert "ReusedExchange" in plan and plan.count("FileScan parquet") == 1


def test_j19_with_null_ids(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(None, "ACDEFG"), (3, "ACDEFG"), (None, "MKL MKL"), (2**40, "WWWW"), (5, None), (6, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ours = catalog.queries()["j19_provenance"](spark, str(tmp_path)).select("sequence", "n", "protein_id", "start_pos").collect()
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = duck.execute(f"select sequence, n, protein_id, start_pos from ({catalog.oracle_sql()['j19_provenance']})").fetchall()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, theirs))
