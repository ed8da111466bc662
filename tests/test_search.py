"""The proteome search resumes; windows and initial populations."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.operators import generate
from seqspark.plans import search


@pytest.fixture(scope="module")
def proteins(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(f"p{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))) for i, n in enumerate((3, 40, 150, 700))], "protein_id string, sequence string")


def test_a_resumed_proteome_search_is_an_unbroken_one(spark, proteins, tmp_path):
    score = lambda df: df.withColumn("objective", properties.gravy(F.col("sequence")))
    phases = [search.Phase("standard_deviation", 1), search.Phase("expected_improvement", 1)]
    how = {"n_initial": 12, "pool": 24, "batch": 4}
    rows = lambda df: sorted(tuple(r) for r in df.select("iteration", "sequence", "protein_id", "start_pos").collect())
    whole = rows(search.search_proteome(proteins, score, phases, f"file://{tmp_path}/a", tune_every=1, **how))
    search.search_proteome(proteins, score, phases[:1], f"file://{tmp_path}/b", tune_every=1, **how)
    assert rows(search.search_proteome(proteins, score, phases, f"file://{tmp_path}/b", tune_every=1, **how)) == whole
    assert len(whole) == 20 and len({r[1] for r in whole}) == 20
    text = dict(proteins.collect())
    assert all(text[p][s : s + len(q)] == q for _, q, p, s in whole)


def test_windows(proteins):
    got = {(r.protein_id, r.start_pos, r.sequence) for r in generate.tiles(proteins, 6, chunk=7).collect()}
    assert got == {(p, i, s[i : i + 6]) for p, s in proteins.collect() for i in range(len(s) - 5)}


def test_initial_population(spark):
    one = spark.createDataFrame([("ACDEFGHIKL",)], "sequence string")
    grown = [r[0] for r in generate.initial_population(one, 8).collect()]
    assert len(set(grown)) == 8 and "ACDEFGHIKL" in grown
    assert generate.initial_population(one.unionByName(spark.createDataFrame([("LLLL",)], "sequence string")), 1).count() == 2
    with pytest.raises(ValueError):
        generate.initial_population(one.limit(0), 3)
    assert [search.tune_due(i, 2) for i in (1, 2, 3)] == [True, False, True] and not search.tune_due(1, None)


def test_pools_are_full_whenever_there_are_enough(spark):
    """Two letters of three stay within short lengths, so nearly every possible child is asked for."""
    parents = spark.createDataFrame([("AAC",)], "sequence string")
    known = parents.unionByName(spark.createDataFrame([("AAD",), ("AAE",)], "sequence string"))
    got = [r[0] for r in generate.mutant_pool(parents, 50, known, shortest=3, longest=3, rate=0.01).collect()]
    # One substitution gives 57 strings, two of them known; more edits give others.
    assert len(got) == len(set(got)) == 50 and not {"AAC", "AAD", "AAE"} & set(got) and all(len(s) == 3 for s in got)
    few = generate.mutant_pool(parents, 7000, parents, shortest=3, longest=3, rate=0.0, tries=4).collect()
    assert 55 <= len(few) <= 57  # a single edit can give no more
    again = [r[0] for r in generate.mutant_pool(parents, 50, known, shortest=3, longest=3, rate=0.01).collect()]
    assert sorted(again) == sorted(got)
    assert generate.mutant_pool(parents.limit(0), 5, known).count() == 0


def test_edits_have_no_cap(spark):
    rows = spark.range(400).select("id", F.expr("repeat('ACDEFGHIKL', 300)").alias("parent"))
    n = rows.select(generate.poisson_count(F.length("parent") * 0.5, 1, "id").alias("n")).agg(F.avg("n"), F.var_samp("n"), F.min("n")).first()
    assert abs(n[0] - 1500) < 8 and abs(n[1] - 1500) < 450 and n[2] > 1300
    small = spark.range(20_000).select(generate.poisson(F.lit(1.0), generate.uniform(3, "id")).alias("n")).agg(F.avg("n"), F.var_samp("n"), F.max("n")).first()
    assert abs(small[0] - 1) < 0.03 and abs(small[1] - 1) < 0.06 and small[2] >= 6


def test_peptides_are_found_to_the_last(spark, proteins):
    """All windows of three letters of one protein, asked for at once."""
    one = proteins.where("protein_id = 'p1'")
    text = one.first().sequence
    wanted = {text[i : i + 7] for i in range(len(text) - 6)}
    got = generate.global_peptides(one, len(wanted) - 4, one.limit(0), 7, 7).collect()
    assert len({r.sequence for r in got}) == len(wanted) - 4 and {r.sequence for r in got} <= wanted
    near = generate.near_peptides(spark.createDataFrame([("p1", 10, text[10:17])], "protein_id string, start_pos int, sequence string"), one, 6, one.limit(0), 7, 9).collect()
    assert len({r.sequence for r in near}) == 6


def test_peptides_read_proteins_and_known_sequences_a_few_times(spark, proteins, monkeypatch):
    """One reading of the proteins for their lengths and one for each kind of window, one of the known ones; and rounds of any size find the same."""

    def counted(df):
        read = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema), read

    text = dict(proteins.collect())
    scored = spark.createDataFrame([("p2", at, text["p2"][at : at + 9]) for at in (20, 60, 90)], "protein_id string, start_pos int, sequence string")
    known = generate.tiles(proteins, 9).select("sequence").localCheckpoint()
    found = lambda *tables: sorted(tuple(r) for r in generate.mixed_peptides(scored, *tables[:1], 60, 0.5, tables[1], 7, 12).collect())
    (own, of_proteins), (seen, of_known) = counted(proteins), counted(known)
    got = found(own, seen)
    assert of_proteins.value <= 3 * proteins.count() and of_known.value <= known.count()
    assert len(got) == 60 == len({r[2] for r in got}) and sum(r[3] == "local" for r in got) == 30
    assert all(text[p][s : s + len(q)] == q and len(q) != 9 for p, s, q, _ in got)
    monkeypatch.setattr(generate, "_AT_ONCE", 64)
    monkeypatch.setattr(generate, "FEW", 0)
    assert found(proteins, known) == got
