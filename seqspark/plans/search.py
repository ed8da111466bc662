"""Guided search: every step is a table, and a loop holds only scalars and the picked batch on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.operators import acquire, cluster, embed, filters, generate, select, store, surrogate
from seqspark.sources import sinks

Scorer = Callable[[DataFrame], DataFrame]
#: Properties that peptides are embedded by: hydropathy, mass, charge, and membership of the letter sets.
PROPERTY_TABLE = {
    "hydropathy": properties.HYDROPATHY,
    "mass": {a: m / 100 for a, m in properties.MASS.items()},
    "charge": {"K": 1.0, "R": 1.0, "H": 0.5, "D": -1.0, "E": -1.0},
    **{name: dict.fromkeys(letters, 1.0) for name, letters in (("helix", properties.HELIX), ("turn", properties.TURN), ("sheet", properties.SHEET), ("polar", properties.POLAR))},
}


@dataclass
class Phase:
    acquisition: str
    iterations: int

    def __post_init__(self):
        if self.iterations < 1:
            raise ValueError("a phase has one iteration at least")
        if self.acquisition not in acquire.SINGLE and self.acquisition not in acquire.MULTI:
            raise ValueError(f"no acquisition called {self.acquisition}")


def replay_scorer(scores: DataFrame, key: str = "seq_id") -> Scorer:
    """Scores are looked up; rows without one are dropped."""
    return lambda batch: batch.select(key).join(scores, key)


def site_scorer(score: Scorer, sites: DataFrame, key: str = "seq_id", default: list[int] | None = None) -> Scorer:
    """A scorer that gets each row with ``site``, its own binding site out of ``sites`` (key, res_idx): its residues in order; ``default`` for rows without one, null where there is none either."""
    own = sites.groupBy(key).agg(F.array_sort(F.collect_set("res_idx")).alias("site"))
    other = F.lit(None).cast("array<bigint>") if default is None else F.array(*(F.lit(int(i)).cast("bigint") for i in sorted(set(default))))
    return lambda batch: score(batch.join(own, key, "left").withColumn("site", F.coalesce(F.col("site").cast("array<bigint>"), other)))


def _schedule(phases: list[Phase], multi: bool = False):
    if not phases:
        raise ValueError("a search has one phase at least")
    known = acquire.MULTI if multi else acquire.SINGLE
    for p in phases:
        if p.acquisition not in known:
            raise ValueError(f"{p.acquisition} isn't an acquisition for {'several objectives' if multi else 'one objective'}")
    return [p for p in phases for _ in range(p.iterations)]


def _last(spark: SparkSession, path: str) -> int | None:
    """The last iteration of a log, None where there is no log."""
    return sinks.read_log(spark, path).agg(F.max("iteration")).first()[0] if sinks.exists(spark, path) else None


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tune_due(iteration: int, every: int | None) -> bool:
    """Whether parameters are tuned in this iteration (from 1): the first, and then each ``every``-th; never without ``every``."""
    return bool(every) and (iteration - 1) % every == 0


def _parameters(rows: DataFrame, path: str, i: int, every: int | None, n_trials: int, seed: int) -> dict:
    """Width and ridge for iteration i: tuned where it is due, with the best trials of the last tuning tried again; else those of the last iteration. Both are stored under ``path``."""
    spark = rows.sparkSession
    known = [v for v in store.versions(spark, f"{path}-models") if v < i]
    last = store.load_models(spark, f"{path}-models", known[-1])["parameters"] if known else {"width": 0.0, "ridge": 1.0, "tuned": 0.0}
    if not tune_due(i, every):
        return last
    earlier = spark.read.parquet(f"{path}-trials/iteration={int(last['tuned'])}") if last["tuned"] else None
    best, trials = surrogate.tuned(rows, n_trials, 3, seed + i, earlier)
    _stored(trials, f"{path}-trials/iteration={i}")
    return {"width": float(best["width"]), "ridge": float(best["ridge"]), "tuned": float(i)}


def _how(phase: Phase, best: float) -> dict:
    return {"best": best} if phase.acquisition in ("expected_improvement", "probability_of_improvement") else {}


def initial_picks(candidates: DataFrame, n: int, method: str = "random", seed: int = 42) -> DataFrame:
    """(seq_id, ...) of n candidates to begin with: at random, the members nearest to the centres of n clusters (kmeans), or spread by squared distance (kmeans++)."""
    if method == "random":
        return select.random_rows(candidates, n, seed)
    if method not in ("kmeans", "kmeans++"):
        raise ValueError(f"no initial selection called {method}")
    picked = cluster.cluster_picks(candidates, n, seed) if method == "kmeans" else select.spread_picks(candidates, n, seed)
    return candidates.join(F.broadcast(picked.select("seq_id")), "seq_id", "left_semi")  # n rows


def search_candidates(candidates: DataFrame, scorer: Scorer, phases: list[Phase], path: str, n_initial: int = 10, batch: int = 10, kind: str = "evidential", initial: str = "random", tune_every: int | None = None, n_trials: int = 20, seed: int = 42) -> DataFrame:
    """Search over a fixed table (seq_id, embedding). ``scorer`` maps seq_id rows to (seq_id, objective). Returns the log of all iterations.

    The log is written under ``path``, a partition for each iteration, and each iteration's model and parameters under ``path``-models; a search that finds a log goes on after
    its last whole iteration. ``tune_every`` tunes width and ridge in the first iteration and then each so many. It ends early when no candidate is left.
    """
    spark, schedule, done = candidates.sparkSession, _schedule(phases), _last(candidates.sparkSession, path)
    if done is None:
        sinks.append_iteration(scorer(initial_picks(candidates, n_initial, initial, seed)).select("seq_id", "objective"), path, 0, "initial")
        done = 0
    for i, phase in enumerate(schedule, 1):
        if i <= done:
            continue
        log = sinks.read_log(spark, path).where(F.col("iteration") < i)
        left = filters.not_evaluated(candidates, log, "seq_id")
        if left.isEmpty():
            break
        rows = candidates.join(log.select("seq_id", F.col("objective").alias("y")), "seq_id")
        used = _parameters(rows, path, i, tune_every, n_trials, seed)
        model = surrogate.fit(rows, kind, width=int(used["width"]), ridge=used["ridge"], seed=seed)
        store.save_models(spark, {"parameters": used, "surrogate": model}, f"{path}-models", i)
        best = log.agg(F.max("objective")).first()[0]
        # Stored once: every pick of the batch reads the values, none runs the model again.
        valued = _stored(acquire.acquisition(model.predict(left), phase.acquisition, **_how(phase, float(best))).select("seq_id", "embedding", "acquisition"), f"{path}-valued/{i}")
        picked = select.greedy_batch(valued, batch)
        sinks.append_iteration(scorer(picked).select("seq_id", "objective"), path, i, phase.acquisition)
    return sinks.read_log(spark, path)


def property_embedding(sequences: DataFrame) -> DataFrame:
    """``sequences`` with seq_id and embedding: the means of PROPERTY_TABLE over the letters, and the length."""
    table = {name: {a: float(v) for a, v in values.items()} for name, values in PROPERTY_TABLE.items()}
    return sequences.withColumn("embedding", F.concat(embed.property_means(F.col("sequence"), table), F.array(F.length("sequence") / 20))).withColumn("seq_id", F.col("sequence"))


def outside_components(sequences: DataFrame, n: int, path: str) -> embed.Components:
    """Principal components of an outside table (sequence), fitted once: where ``path`` has them they are read, so a resumed search embeds as the one before."""
    spark = sequences.sparkSession
    found = store.load_models(spark, path)
    if not found:
        store.save_models(spark, {"components": embed.Components.fit(property_embedding(sequences.select("sequence").distinct()), n=n, size=len(PROPERTY_TABLE) + 1)}, path, 0)
        found = store.load_models(spark, path)
    return found["components"]


def search_proteome(proteins: DataFrame, scorer: Scorer, phases: list[Phase], path: str, n_initial: int = 500, pool: int = 10_000, batch: int = 10, local: float = 0.5, n_top: int = 20, low: int = 7, high: int = 20, kind: str = "evidential", tune_every: int | None = None, n_trials: int = 20, fit_data: DataFrame | None = None, n_components: int = 5, seed: int = 42) -> DataFrame:
    """Search over peptides of ``proteins`` (protein_id, sequence). ``scorer`` adds objective to rows of sequences. Returns the log of all iterations.

    Each iteration samples ``pool`` new peptides, a share ``local`` of them around the best ``n_top``, embeds them by their properties (with ``fit_data``, by
    ``n_components`` principal components of that outside table), and scores the ``batch`` of the
    largest acquisition. The log is a table with a partition for each iteration; a search that finds one goes on after its last whole
    iteration and comes to the same log, since all draws depend on seed and iteration alone and models, parameters and components are stored. It ends early when no peptide is left.
    """
    spark, schedule, done = proteins.sparkSession, _schedule(phases), _last(proteins.sparkSession, path)
    columns = ["protein_id", "start_pos", "sequence", "objective"]
    components = outside_components(fit_data, n_components, f"{path}-components") if fit_data is not None else None
    embedded = (lambda df: components.transform(property_embedding(df))) if components is not None else property_embedding
    if done is not None and done >= len(schedule):
        return sinks.read_log(spark, path)
    indexed = generate.protein_index(proteins)  # once for all iterations
    if done is None:
        none = proteins.select("sequence").limit(0)
        first = _stored(generate.global_peptides(proteins, n_initial, none, low, high, seed=seed, indexed=indexed), f"{path}-pool/0")
        sinks.append_iteration(scorer(first).select(*columns), path, 0, "initial")
        done = 0
    for i, phase in enumerate(schedule, 1):
        if i <= done:
            continue
        log = sinks.read_log(spark, path).where(F.col("iteration") < i)
        best = log.orderBy(F.desc("objective"), "sequence").limit(n_top)
        fresh = _stored(generate.mixed_peptides(best, proteins, pool, local, log, low, high, seed=seed + 100_000 * i, indexed=indexed), f"{path}-pool/{i}")
        if fresh.isEmpty():
            break
        rows = embedded(log.withColumn("y", F.col("objective")))
        used = _parameters(rows, path, i, tune_every, n_trials, seed)
        model = surrogate.fit(rows, kind, width=int(used["width"]), ridge=used["ridge"], seed=seed)
        store.save_models(spark, {"parameters": used, "surrogate": model}, f"{path}-models", i)
        valued = acquire.acquisition(model.predict(embedded(fresh)), phase.acquisition, **_how(phase, float(log.agg(F.max("objective")).first()[0])))
        picked = select.top_by(valued, "acquisition", batch).select("protein_id", "start_pos", "sequence")
        sinks.append_iteration(scorer(picked).select(*columns), path, i, phase.acquisition)
    return sinks.read_log(spark, path)


@dataclass
class Parents:
    """How parents are chosen: out of the whole history or the last batch, among the best share or number; uniformly, by exponential weights, or all within ``kappa`` of the best (adalead, one objective only)."""

    method: str = "uniform"
    top: float | int = 0.3
    beta: float = 1.0
    kappa: float = 0.05
    pool: str = "full_history"

    def __post_init__(self):
        if self.method not in ("uniform", "exponential", "adalead"):
            raise ValueError(f"no selection of parents called {self.method}")
        if self.pool not in ("full_history", "last_batch"):
            raise ValueError(f"no pool of parents called {self.pool}")

    def choose(self, scored: DataFrame, m: int, directions: dict[str, str] | None, seed: int) -> DataFrame:
        """(sequence) of the parents out of ``scored`` (sequence, objective; or with ``directions`` sequence, obj, value)."""
        if directions is not None:
            if self.method == "adalead":
                raise ValueError("adalead is for one objective")
            if self.method == "uniform":
                return select.parents_by_objective(scored, m, self.top, directions, seed, "sequence").select("sequence")
            best = scored.join(select.top_of_any(scored, self.top, directions, "sequence"), "sequence", "left_semi")
            return select.exponential_parents_multi(best, m, directions, self.beta, seed, "sequence").select("sequence")
        if self.method == "adalead":
            return select.adalead(scored, self.kappa).select("sequence")
        if self.method == "uniform":
            return select.parents(scored, m, self.top, seed, "sequence").select("sequence")
        n = max(m, select.share_or_number(self.top, scored.count()))
        return select.exponential_parents(select.best_rows(scored, n, "sequence"), m, self.beta, seed=seed, key="sequence").select("sequence")


def evolve(given: DataFrame, scorer: Scorer, phases: list[Phase], path: str, n_initial: int = 100, m_select: int = 10, pool: int = 1000, parents: Parents | None = None, directions: dict[str, str] | None = None, n_components: int | None = None, kind: str = "evidential", tune_every: int | None = None, n_trials: int = 20, seed: int = 42, **mutation) -> DataFrame:
    """Evolutionary search guided by a surrogate. ``given`` (sequence) is filled up to ``n_initial`` by mutants and scored; each generation then mutates parents into a pool,
    predicts all of it, and has ``scorer`` score the ``m_select`` of the largest acquisition and nothing else. Returns the log of all generations.

    ``scorer`` maps rows (sequence) to (sequence, objective); with ``directions`` (objective -> max or min) to rows (sequence, obj, value), one for each objective.
    Scored sequences and pool are embedded together: their scaling, and their ``n_components`` principal components, are fitted anew in each generation.
    All that a generation fits is stored under ``path``-models, a version for each. A search that finds a log goes on after its last whole generation and comes to the
    same log, since all draws depend on seed and generation alone. It ends early when no new child can be made. ``mutation``: rate, shortest, longest.
    """
    multi, parents = directions is not None, parents or Parents()
    spark, schedule, done = given.sparkSession, _schedule(phases, multi), _last(given.sparkSession, path)
    columns = ["sequence", "obj", "value"] if multi else ["sequence", "objective"]
    if done is None:
        start = _stored(generate.initial_population(given, n_initial, least=(n_components or 0) + 1, seed=seed, **mutation), f"{path}-pool/0")
        sinks.append_iteration(scorer(start).select(*columns), path, 0, "initial")
        done = 0
    for g, phase in enumerate(schedule, 1):
        if g <= done:
            continue
        log = sinks.read_log(spark, path).where(F.col("iteration") < g)
        pooled = log.where(F.col("iteration") == g - 1) if parents.pool == "last_batch" and g > 1 else log
        chosen = parents.choose(pooled.select(*columns), m_select, directions, seed + g)
        children = _stored(generate.mutant_pool(chosen, pool, log, seed=1000 * g + seed, **mutation), f"{path}-pool/{g}")
        if children.isEmpty():
            break
        both = property_embedding(log.select("sequence").distinct().unionByName(children))
        fitted = {"scaler": embed.scaler(both)}
        embedded = lambda df, scale=fitted["scaler"]: embed.scaled(property_embedding(df), scale)
        if n_components:
            fitted["components"] = axes = embed.Components.fit(embed.scaled(both, fitted["scaler"]), n=n_components)
            embedded = lambda df, scale=fitted["scaler"], axes=axes: axes.transform(embed.scaled(property_embedding(df), scale))
        rows = embedded(log.withColumn("y", F.col("value" if multi else "objective")))
        candidates = embedded(children)
        if multi:
            fitted["parameters"] = used = _parameters(rows.where(F.col("obj") == min(directions)), path, g, tune_every, n_trials, seed)
            models = surrogate.fit_each(rows, int(used["width"]), used["ridge"], seed)
            fitted |= {f"surrogate_{obj}": m for obj, m in models.items()}
            how = {"directions": directions, "weights": dict(zip(sorted(directions), acquire.simplex_weights(len(directions), seed, g), strict=True))}
            predicted = surrogate.predict_each(models, candidates)
        else:
            fitted["parameters"] = used = _parameters(rows, path, g, tune_every, n_trials, seed)
            fitted["surrogate"] = model = surrogate.fit(rows, kind, width=int(used["width"]), ridge=used["ridge"], seed=seed)
            predicted, how = model.predict(candidates), _how(phase, float(log.agg(F.max("objective")).first()[0]))
        store.save_models(spark, fitted, f"{path}-models", g)
        valued = acquire.acquisition(predicted, phase.acquisition, **how)
        picked = select.top_by(valued, "acquisition", m_select).select(F.col("seq_id").alias("sequence"))
        sinks.append_iteration(scorer(_stored(picked, f"{path}-picked/{g}")).select(*columns), path, g, phase.acquisition)
    return sinks.read_log(spark, path)
