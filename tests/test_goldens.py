"""Values worked out by hand, and properties that hold on any partitioning."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspark.functions import exprs, properties
from seqspark.operators import acquire, confidence, embed, filters, generate, select, surrogate


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame([(1, 1.0, 0.1), (2, 2.0, 0.2), (3, 3.0, 0.3)], "seq_id long, mean double, std double")


def values(df, column="acquisition"):
    return [r[0] for r in df.orderBy("seq_id").select(column).collect()]


def test_expected_improvement(predictions):
    assert values(acquire.acquisition(predictions, "expected_improvement", best=0.0)) == pytest.approx([1, 2, 3])
    assert values(acquire.acquisition(predictions, "expected_improvement", best=2.0)) == pytest.approx([7.6946e-24, 0.07978845608028655, 1.0000336233656903], rel=1e-4)
    assert acquire.advance_best(predictions) == 3.0


def test_bounds_and_probability(predictions):
    assert values(acquire.acquisition(predictions, "upper_confidence_bound")) == pytest.approx([1.196, 2.392, 3.588])
    assert values(acquire.acquisition(predictions, "upper_confidence_bound", maximise=False)) == pytest.approx([0.804, 1.608, 2.412])
    assert values(acquire.acquisition(predictions, "probability_of_improvement", best=2.0)) == pytest.approx([0, 0.5, 0.9995709396668031], abs=1e-12)
    with pytest.raises(ValueError):
        acquire.acquisition(predictions, "no such thing")


def test_objective_v1(spark):
    rows = [(-43.0, 6.4, -574.0, 8.39, 0.86, True), (-10.933749597646795, 6.070098449822542, -352.43062003747855, 25.55502085070889, 0.25, True), (0.0, 0.0, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "interface_dg double, distance_score double, rosetta_score double, sequence_pae double, iptm double, in_binding_site boolean")
    assert [r[0] for r in df.select(acquire.objective_v1()).collect()] == pytest.approx([5.8094886881138885, 0.21621160762107358, -1])


def test_properties(spark):
    df = spark.createDataFrame([("KSLLQQLLTE",), (exprs.ALPHABET,)], "sequence string")
    got = df.select(properties.hydrophobic_moment(F.col("sequence")).alias("m"), properties.gravy(F.col("sequence")).alias("g")).collect()
    assert [r.m for r in got] == pytest.approx([0.4875466167151874, 0.049942186485210115])
    assert [r.g for r in got] == pytest.approx([-0.07, -0.49])


def test_properties_of_odd_sequences(spark, monkeypatch):
    """The batch forms equal the single columns for nulls, empty and long sequences and letters of several bytes."""
    monkeypatch.setattr(properties, "PIECE", 7)
    code, at = properties._letters(pa.array(["ACDEFGHIKL" * 3, None, "", "éKé", "W"])[1:])
    assert at.tolist() == [0, 0, 0, 3, 4] and code.tolist() == [26, 10, 26, 22]
    monkeypatch.undo()
    rows = ["ACDEFGHIKLMNPQRSTVWY" * 500, "KSLLQQLLTE", None, "", "W", "éKéRé", "acK", "X-Z", "D"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").repartition(1)
    weights = {"KS": 1.5, "AC": -2.0, "YA": 0.25}
    wide = properties.with_all_properties(df, "s", weights)
    s = F.col("s")
    single = df.select("i", "s", *properties.all_properties(s), properties.instability(s, weights).alias("instability"), F.when(s.isNotNull(), properties.isoelectric_point(s)).alias("isoelectric_point"))
    assert wide.columns == single.columns
    for a, b in zip(wide.orderBy("i").collect(), single.orderBy("i").collect(), strict=True):
        assert [x is None for x in a] == [x is None for x in b], (a, b)
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=1e-9)
        assert a.length == b.length
    got = {r.s: r for r in wide.collect()}
    assert got["KSLLQQLLTE"].instability == pytest.approx(1.5) and got["ACDEFGHIKLMNPQRSTVWY" * 500].instability == pytest.approx(10 * (499 * 0.25 - 500 * 2.0) / 10000)


def test_properties_piece_by_piece(spark, monkeypatch):
    a = pa.array(["KSLLQQLLTE", None, "ACDEFGHIKLMNPQRSTVWYAC" * 4, ""])
    code, at = properties._letters(a)
    weights = {"KS": 1.5, "AC": -2.0, "YA": 0.25}
    whole = properties._moments(code, at, 100.0), properties._instabilities(code, at, weights).to_pylist()
    monkeypatch.setattr(properties, "PIECE", 3)
    assert properties._moments(code, at, 100.0) == pytest.approx(whole[0]) and properties._instabilities(code, at, weights).to_pylist() == pytest.approx(whole[1])


def test_no_lambda_works_on_letters(spark):
    """A lambda is interpreted for each letter, which took most of the time of p04, p15 and p16."""
    from seqspark.plans import catalog

    for name in ("p04_instability_index", "p15_hydrophobic_moment", "p16_all_properties"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan, name


def test_edits_are_few_expressions(spark):
    """Counts are those of the plain sum, long parents and many edits included, and a filter on children doesn't multiply the plan."""
    df = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY" * (1 + i % 3 * 100)) for i in range(60)], "id long, parent string")
    u, mean = exprs.uniform(42, "id", F.lit("edits"), F.lit(1)), F.length("parent") * 0.05
    rows = df.where("length(parent) < 9000").withColumn("u", u).select(generate._edits(mean, F.col("u"), generate.poisson(mean, F.col("u"))).alias("a"), F.greatest(F.lit(1), generate.poisson_count(mean, 42, "id", F.lit("edits"))).alias("b"))
    assert all(r.a == r.b for r in rows.collect())
    plan = generate.mutated(df, longest=9000).where("sequence <> parent and length(sequence) between 5 and 9000")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") < 100


def test_known_sequences_are_neither_shuffled_nor_distinct(spark):
    known = spark.createDataFrame([("A",), ("C",), ("C",), (None,)], "sequence string")
    rows = spark.createDataFrame([(1, "C"), (2, "D"), (3, "D"), (4, None)], "id int, sequence string")
    out = generate._unknown(rows, known)
    assert sorted(r.id for r in out.collect()) == [2, 3, 4]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_residue_components_without_residue_rows(spark):
    """One pass and letters alone give the components, arrays and means of residue rows; unknown letters count as 0."""
    table = {"a": {"A": 1.0, "C": -2.0, "K": 0.5}, "b": {"A": 0.3, "W": 1.0}, "c": {"K": 2.0, "D": -1.0}}
    df = spark.createDataFrame([("ACKW",), ("DDXA",), ("é",), ("",), ("KKCAWD",)], "sequence string").repartition(2)
    rows = embed.residue_embedding(df, table)
    old, new = embed.Components.fit(rows, n=2), embed.Components.fit(rows, n=2, size=3)
    assert new.mean == pytest.approx(old.mean) and sum(new.axes, []) == pytest.approx(sum(old.axes, [])) and new.explained == pytest.approx(old.explained)
    want = {r.sequence: r.embedding for r in embed.regrouped(new.transform(rows)).collect()}
    got = {r.sequence: r.embedding for r in embed.residue_arrays(df, *new.of_letters(table)).collect()}
    assert want.keys() == got.keys()
    assert all(sum(got[k], []) == pytest.approx(sum(want[k], [])) for k in want)
    by = lambda x: {r.sequence: r.embedding for r in x.collect()}
    a, b = by(embed.pooled(rows)), by(embed.pooled(rows, size=3))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    means = by(embed.average_embedding(df, table))
    assert means[""] == [None] * 3 and all(means[k] == pytest.approx(a[k]) for k in a)


def test_one_job_reads_residues_once(spark):
    from seqspark.plans import catalog

    plan = catalog.queries()["g09_pooled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(split") <= 1 and "collect_list" not in plan and "lambdafunction" not in plan


def test_kinds_of_tiles(spark):
    """Equals the count over rows of windows: repeats, ids of several rows, null ids, other letters, short and null sequences."""
    data = [(1, "ACACACACACACAC"), (1, "ACACACACKK"), (2, "ACD"), (3, None), (None, "KKKKKKKKK"), (None, "KKKKKKKKW"), (4, "éACDEFGHIéACDEFGHI"), (5, "ACDEFGHIKLMNPQRSTVWY" * 100)]
    df = spark.createDataFrame(data, "protein_id long, sequence string").repartition(3)
    for length in (3, 8, 13):
        want = generate.tiles(df, length).groupBy("protein_id").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("kinds"))
        got = generate.tile_kinds(df, length)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.columns == want.columns
    plan = generate.tile_kinds(df, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_local_peptides_of_one_join(spark):
    """The same copies as by two joins, at the borders of pieces and of proteins, with wide shifts; proteins are joined once."""
    proteins = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY" * n + "WK" * i) for i, n in enumerate((0, 1, 30, 120))], "protein_id long, sequence string")
    scored = proteins.where("protein_id > 0").selectExpr("protein_id", "explode(sequence(0, length(sequence) - 3, 7)) start_pos", "'ACDEFGHIK' sequence")
    for spread in (3.0, 60.0):
        copies = scored.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(1))))
        want = generate._local(copies, proteins, spread, 2.0, 7, 20, 42)
        got = generate.local_peptides(scored, proteins, 2, spread, 2.0, 7, 20)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_repeat_rule(spark):
    df = spark.createDataFrame([("ACCCCCCD",), ("ACCCCCD",)], "sequence string")
    assert [r[0] for r in filters.quality_filter(df, most_share=1.0).collect()] == ["ACCCCCD"]


def test_adalead(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.0, 0.3, 0.7, 0.8, 0.9])], "seq_id long, objective double")
    assert {r.objective for r in select.adalead(df, 0.2).collect()} == {1.0, 0.9, 0.8}
    assert {r.objective for r in select.adalead(df, 0.01).collect()} == {1.0}


def test_scale_of_small_interfaces(spark):
    got = spark.range(1).select(confidence.d0(F.lit(5)), confidence.d0(F.lit(50))).first()
    assert list(got) == pytest.approx([1.0388913215322628, 2.2561222246338515])


def test_mutants_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, "ACDEFGHIKL") for i in range(200)], "id long, parent string")
    a, b = (dict(generate.mutated(rows.repartition(n)).select("id", "sequence").collect()) for n in (1, 16))
    assert a == b
    assert all(4 <= len(s) and set(s) <= set(exprs.ALPHABET) for s in a.values())
    assert sum(s != "ACDEFGHIKL" for s in a.values()) == 200


def test_mutant_pool_is_fresh(spark):
    parents = spark.createDataFrame([("ACDEFGHIKL",), ("LLLLAAAKKK",)], "sequence string")
    pool = [r[0] for r in generate.mutant_pool(parents, 30, parents).collect()]
    assert len(pool) == len(set(pool)) == 30 and not set(pool) & {"ACDEFGHIKL", "LLLLAAAKKK"}


@pytest.mark.parametrize("kind", ["evidential", "ensemble", "draws", "mean_variance"])
def test_surrogates_fit_a_line(spark, kind):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame([(i, e, 2 * e[0] - e[1] + 0.1 * rng.gauss(0, 1)) for i, e in rows], "seq_id long, embedding array<double>, y double")
    got = surrogate.fit(df, kind, ridge=0.1).predict(df).select("y", "mean", "std").collect()
    assert sum((r.y - r["mean"]) ** 2 for r in got) / len(got) < 0.05
    assert all(r["std"] > 0 for r in got)


def test_isoelectric_points_of_both_forms(spark):
    from seqspark.functions import properties

    rows = spark.createDataFrame([(x, 1.5) for x in ("KSLLQQLLTE", "ACDEFGHIKLMNPQRSTVWY", "A", "D", "K" * 30, "E" * 30, "CYH", "MKRDE", "PPPP", "")], "sequence string, _lo double")
    got = properties.with_isoelectric_point(rows.drop("_lo"), F.col("sequence"), "found").withColumn("again", properties.isoelectric_point(F.col("sequence"))).collect()
    assert len(got) == 10 and all(r.found == r.again for r in got)
