"""Tuning against plain fits, the model store, and the guided evolutionary search."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.operators import acquire, embed, select, store, surrogate
from seqspark.plans import search


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (240, 4))
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + rng.normal(0, 0.1, 240)
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "seq_id long, embedding array<double>, y double").cache()


def test_cross_validation_is_that_of_single_fits(rows):
    trials = [{"width": 0, "ridge": 0.5}, {"width": 8, "ridge": 0.01}, {"width": 3, "ridge": 5.0}]
    got = dict(surrogate.cross_validate(rows, trials, folds=3).collect())
    dealt = rows.withColumn("fold", F.floor(surrogate.uniform(42, "seq_id") * 3))
    for k, t in enumerate(trials):
        each = []
        for f in range(3):
            model = surrogate.fit(dealt.where(F.col("fold") != f).drop("fold"), width=t["width"], ridge=t["ridge"])
            left = model.predict(dealt.where(F.col("fold") == f)).select("y", "mean", "std").collect()
            each.append(np.mean([0.5 * (((r.y - r["mean"]) / r["std"]) ** 2 + 2 * math.log(r["std"]) + math.log(2 * math.pi)) for r in left]))
        assert got[k] == pytest.approx(np.mean(each), rel=1e-6)
    assert surrogate.cross_validate(rows.limit(0), trials).count() == 0


def test_jobs_of_a_tuning_do_not_grow_with_its_trials(spark, rows):
    def jobs(n, folds):
        spark.sparkContext.setJobGroup(f"tune-{n}", "")
        surrogate.cross_validate(rows, [{"width": 4 * (i % 3), "ridge": 1.0 + i} for i in range(n)], folds=folds).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tune-{n}"))

    few, many = jobs(2, 2), jobs(24, 6)
    spark.sparkContext.setJobGroup("other", "")
    assert few == many


def test_a_tuning_tries_the_best_trials_again(rows):
    best, first = surrogate.tuned(rows, 6)
    again, second = surrogate.tuned(rows, 2, seed=9, earlier=first)
    kept = {(r.width, r.ridge) for r in first.orderBy("nll", "trial").limit(5).collect()}
    tried = {(r.width, r.ridge) for r in second.collect()}
    assert kept <= tried and len(tried) == 7 and again["nll"] <= best["nll"] + 1e-12


def test_models_are_read_back_bit_for_bit(spark, rows, tmp_path):
    at = f"file://{tmp_path}/models"
    models = {kind: surrogate.fit(rows, kind, width=5, members=3) for kind in ("evidential", "ensemble", "draws", "mean_variance")}
    models |= {"plain": surrogate.fit(rows), "axes": embed.Components.fit(rows, n=2), "numbers": {"width": 5.0, "ridge": 1 / 3}, "scaler": embed.scaler(rows)}
    store.save_models(spark, models, at, 3)
    store.save_models(spark, {"numbers": {"ridge": 2.0}}, at, 12)
    assert store.versions(spark, at) == [3, 12] and store.load_models(spark, at) == {"numbers": {"ridge": 2.0}}
    found = store.load_models(spark, at, 3)
    for name in ("evidential", "ensemble", "draws", "mean_variance", "plain"):
        predict = lambda m: m.predict(rows).select("seq_id", "mean", "std").orderBy("seq_id").collect()
        assert predict(found[name]) == predict(models[name])
    assert found["axes"].transform(rows).collect() == models["axes"].transform(rows).collect()
    assert found["numbers"] == models["numbers"]
    assert embed.scaled(rows, found["scaler"]).collect() == embed.scaled(rows, models["scaler"]).collect()
    assert store.load_models(spark, f"{at}-none") == {} and store.load_models(spark, at, 4) == {}


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(8)
    return spark.createDataFrame([("".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(12)),) for _ in range(10)], "sequence string")


def counted(score, seen):
    def run(df):
        out = score(df).cache()
        seen.append(df.count())
        return out

    return run


def test_evolution_scores_the_batch_alone_and_resumes(spark, given, tmp_path):
    score = lambda df: df.select("sequence", properties.gravy(F.col("sequence")).alias("objective"))
    phases, seen = [search.Phase("upper_confidence_bound", 1), search.Phase("expected_improvement", 1)], []
    how = {"n_initial": 16, "m_select": 4, "pool": 40, "parents": search.Parents("exponential", top=0.5, beta=3.0), "n_components": 3, "tune_every": 1, "n_trials": 3}
    log = lambda df: sorted(map(tuple, df.select("iteration", "sequence", "objective", "phase").collect()))
    whole = log(search.evolve(given, counted(score, seen), phases, f"file://{tmp_path}/a", **how))
    assert seen == [16, 4, 4] and len({r[1] for r in whole}) == 24
    search.evolve(given, score, phases[:1], f"file://{tmp_path}/b", **how)
    assert log(search.evolve(given, score, phases, f"file://{tmp_path}/b", **how)) == whole
    a, b = (store.load_models(spark, f"file://{tmp_path}/{x}-models") for x in "ab")
    assert a["parameters"] == b["parameters"] and np.array_equal(a["surrogate"].mean, b["surrogate"].mean) and a["components"].axes == b["components"].axes
    # What is picked is the best of the pool by the model, and better than the pool by the score.
    assert np.mean([r[2] for r in whole if r[0] == 2]) > np.mean([r[2] for r in whole if r[0] == 0])


def test_evolution_of_objectives(spark, given, tmp_path):
    def score(df):
        return df.select("sequence", properties.gravy(F.col("sequence")).alias("up"), F.length("sequence").cast("double").alias("down")).unpivot("sequence", ["up", "down"], "obj", "value")

    seen = []
    found = search.evolve(given, counted(score, seen), [search.Phase("parego_chebyshev_ucb", 1)], f"file://{tmp_path}/m", n_initial=12, m_select=3, pool=20, parents=search.Parents("exponential", top=4, pool="last_batch"), directions={"up": "max", "down": "min"})
    assert seen == [12, 3] and found.count() == 30
    with pytest.raises(ValueError):
        search.evolve(given, score, [search.Phase("mean", 1)], f"file://{tmp_path}/n", directions={"up": "max"})
    with pytest.raises(ValueError):
        search.Parents("best")


def test_first_picks(spark, rows):
    for method in ("random", "kmeans", "kmeans++"):
        picked = search.initial_picks(rows.select("seq_id", "embedding"), 7, method)
        assert picked.count() == 7 and picked.select("seq_id").distinct().count() == 7
    with pytest.raises(ValueError):
        search.initial_picks(rows, 3, "best")


def test_parents_of_a_share(spark):
    rows = spark.range(1000).select(F.col("id").alias("seq_id"), (F.col("id") % 100).cast("double").alias("objective"))
    best = {r.seq_id for r in select.best_rows(rows, 205).collect()}
    assert best == {r.seq_id for r in sorted(rows.collect(), key=lambda r: (-r.objective, r.seq_id))[:205]}
    assert {r.seq_id for r in select.parents(rows, 7, 0.2).collect()} <= {r.seq_id for r in rows.where("objective >= 80").collect()}
    flags = surrogate.split(rows.select("seq_id"), 0.25).groupBy("validation").count()
    assert dict(flags.collect()) == {True: 250, False: 750}


def plain_greedy(keys, values, x, n):
    picked, near = [max(range(len(keys)), key=lambda i: (values[i], -keys[i]))], np.full(len(keys), np.inf)
    while len(picked) < min(n, len(keys)):
        d = x - x[picked[-1]]
        near = np.minimum(near, np.sqrt((d * d).sum(1)))
        gain = values * near
        gain[picked] = -np.inf
        best = gain.max()
        picked.append(min((i for i in np.flatnonzero(gain == best)), key=lambda i: keys[i]))
    return [keys[i] for i in picked]


@pytest.mark.parametrize("pool", [3, 50, 4096])
def test_lazy_picks_are_the_plain_ones(spark, pool):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (400, 3)), 1)  # many ties and equal rows
    values = np.round(rng.normal(0.6, 0.5, 400), 1)
    keys = rng.permutation(400).tolist()
    df = spark.createDataFrame([(k, float(v), [float(e) for e in p]) for k, v, p in zip(keys, values, x, strict=True)] + [(900, None, [0.0] * 3), (901, float("nan"), [0.0] * 3)], "seq_id long, acquisition double, embedding array<double>")
    n = 40 if pool == 3 else 120
    got = [r.seq_id for r in select.greedy_batch(df, n, pool=pool).orderBy("rank").collect()]
    assert got == plain_greedy(keys, values, x, n)
    assert select.greedy_batch(df.limit(0), 3).count() == 0


def test_picks_below_zero_and_to_the_end(spark):
    x = [[float(i * i % 7), float(i % 3)] for i in range(12)]
    values = [-1.0, 0.0, 0.5, -0.2, 0.5, 0.0, -3.0, 0.1, 0.2, -0.2, 0.0, 0.3]
    df = spark.createDataFrame([(i, v, e) for i, (v, e) in enumerate(zip(values, x, strict=True))], "seq_id int, acquisition double, embedding array<double>")
    got = [r.seq_id for r in select.greedy_batch(df, 20).orderBy("rank").collect()]
    nonnegative = [i for i, v in enumerate(values) if v >= 0]
    assert sorted(got) == list(range(12)) and sorted(got[: len(nonnegative)]) == nonnegative


def test_many_picks_take_few_jobs(spark):
    e = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: surrogate.uniform(7, "seq_id", i))
    df = spark.range(6000).select(F.col("id").alias("seq_id"), (0.5 + surrogate.uniform(8, "id")).alias("acquisition")).withColumn("embedding", e).cache()
    table = df.toPandas()
    spark.sparkContext.setJobGroup("greedy", "")
    got = [r.seq_id for r in select.greedy_batch(df, 300).orderBy("rank").collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy"))
    spark.sparkContext.setJobGroup("other", "")
    assert got == plain_greedy(table["seq_id"].tolist(), table["acquisition"].to_numpy(), np.stack(table["embedding"]), 300)
    assert jobs < 75


def test_draws_of_several_objectives_read_the_predictions_once(spark):
    """A row without one objective keeps the other; one without a deviation gains nothing."""
    rows = [("a", "x", 1.0, 0.5), ("a", "y", 2.0, 0.1), ("b", "x", 3.0, 0.2), ("c", "x", 0.0, None), ("c", "y", 5.0, 1.0)]
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    table = spark.createDataFrame(rows, "seq_id string, obj string, mean double, std double")
    ways, weights = {"x": "max", "y": "min"}, {"x": 0.6, "y": 0.4}
    got = dict(acquire.parego_ei(table.mapInArrow(run, table.schema), ways, weights, draws=8).collect())
    assert read.value == len(rows)

    def u(*key):
        return (int(hashlib.md5("|".join(map(str, (42, *key))).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    normal = lambda *key: math.sqrt(-2 * math.log(u(*key, "a"))) * math.cos(2 * math.pi * u(*key, "b"))
    signed = {(s, o): (-m if o == "x" else m, d) for s, o, m, d in rows}
    lo, hi = ({o: f(m for (_, p), (m, _) in signed.items() if p == o) for o in ways} for f in (min, max))
    scaled = lambda o, m: weights[o] * (m - lo[o]) / (hi[o] - lo[o])
    value = lambda v: max(v) + 0.05 * sum(v)
    best = min(value([scaled(o, m) for (s, o), (m, _) in signed.items() if s == k]) for k in "abc")
    for k in "ab":
        gains = [max(0.0, best - value([scaled(o, m + d * normal(k, o, j)) for (s, o), (m, d) in signed.items() if s == k])) for j in range(1, 9)]
        assert got[k] == pytest.approx(sum(gains) / 8, abs=1e-12)
    assert got["c"] == 0.0
