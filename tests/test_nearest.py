"""Nearest atoms by growing rings, the leaderboard of a stream, and batch scores of complexes."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators import batch, contacts
from seqspark.streaming import live


def test_nearest_however_far(spark):
    rng = random.Random(3)
    a = [(s, i % 25, *(rng.gauss(0, 40) for _ in range(3))) for s in (1, 2) for i in range(60)] + [(1, 99, 5000.0, 0.0, -700.0), (3, 0, 0.0, 0.0, 0.0), (1, 98, float("nan"), 0.0, 0.0), (2, 97, None, 0.0, 0.0)]
    b = [(s, *(rng.gauss(3, 15) for _ in range(3))) for s in (1, 2) for _ in range(40)] + [(4, 0.0, 0.0, 0.0), (1, 0.0, float("inf"), 0.0)]
    points, others = spark.createDataFrame(a, "structure_id int, res_idx int, x double, y double, z double"), spark.createDataFrame(b, "structure_id int, x double, y double, z double")
    got = {(r.structure_id, r.res_idx): r.d for r in contacts.nearest_distances(points, others, 2.0).collect()}
    expected = {}
    for s, i, *p in a:
        d = [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5 for t, *q in b if t == s and None not in p]
        d = [x for x in d if x < float("inf")]
        if d:
            expected[s, i] = min(*d, expected.get((s, i), float("inf")))
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    assert contacts.nearest_distances(points.limit(0), others).count() == 0


def test_leaderboard_keeps_only_its_rows(spark, tmp_path):
    rng, schema = random.Random(9), "sequence string, objective double"
    where, state, log = (f"file://{tmp_path}/{x}" for x in ("in", "best", "log"))
    every: dict[str, float] = {}
    run = lambda: [(r.sequence, r.objective) for r in live.live_leaderboard(spark.readStream.schema(schema).parquet(where), state, 5, log).orderBy("rank").collect()]
    spark.createDataFrame([], schema).write.parquet(where)
    for k in range(3):
        rows = [(f"S{rng.randrange(40)}", rng.choice([None, rng.gauss(k, 2)])) for _ in range(60)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(where)
        for s, v in rows:
            if v is not None:
                every[s] = max(v, every.get(s, v))
        best = sorted(every.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        assert run() == best
        assert run() == best  # a start without new rows
    kept = live._versions(spark, state)
    assert len(kept) == 2 and all(spark.read.parquet(f"{state}/{v}").count() == 5 for v in kept)


ATOM = "structure_id string, model int, line_no int, hetflag boolean, chain string, res_seq int, icode string, resname string, atom_name string, x double, y double, z double"


def test_scores_of_complexes(spark):
    rows = [("a", 0, 0, False, "A", 5, "", "ALA", "CA", 0.0, 0.0, 0.0), ("a", 0, 1, False, "A", 5, "", "ALA", "CB", 0.0, 1.0, 0.0), ("a", 0, 2, False, "A", 6, "", "GLY", "CA", 30.0, 0.0, 0.0)]
    rows += [("a", 0, 3, False, "B", 1, "", "LYS", "CA", 0.0, 6.0, 0.0), ("a", 0, 4, False, "B", 2, "", "TRP", "CA", 60.0, 0.0, 0.0), ("a", 1, 9, False, "B", 1, "", "LYS", "CA", 0.0, 0.1, 0.0)]
    rows += [("lone", 0, 0, False, "A", 1, "", "ALA", "CA", 0.0, 0.0, 0.0), ("far", 0, 0, False, "A", 1, "", "ALA", "CA", 0.0, 0.0, 0.0), ("far", 0, 1, False, "B", 1, "", "ALA", "CA", 99.0, 0.0, 0.0)]
    metrics = spark.createDataFrame([("a", 0.7, None, [1.0, 2.0, 30.0, 50.0], [[0.0] * 4, [1.0] * 4, [2.0, 4.0, 2.0, 4.0], [5.0] * 4])], "structure_id string, iptm double, ptm double, plddt array<double>, pae array<array<double>>")
    site = spark.createDataFrame([("a", 0), ("a", 1)], "structure_id string, res_idx int")
    wanted = ["distance_score", "n_contacts", "n_in_site", "in_binding_site", "iptm", "sequence_plddt", "sequence_pae", "weighted_plddt", "length"]
    atoms = spark.createDataFrame(rows, ATOM)
    got = {r.structure_id: tuple(r)[1:] for r in batch.complex_scores(atoms, metrics, wanted, site, required=1).collect()}
    assert got["a"] == (6.0, 1, 1, True, 0.7, 40.0, 4.0, 15.0, 2)
    assert got["lone"] == (0.0, 0, 0, False, None, None, None, None, None)
    assert got["far"][:4] == (float("inf"), 0, 0, False)
    assert batch.complex_scores(atoms, metrics, ["iptm"]).columns == ["structure_id", "iptm"]
    for bad in (["nothing"], ["in_binding_site"]):
        with pytest.raises(ValueError):
            batch.complex_scores(atoms, metrics, bad)
    assert batch.complex_scores(atoms.where(F.lit(False)), metrics, wanted, site).count() == 0
