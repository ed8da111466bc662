"""Acquisition values of predictions (mean, std), and objectives of scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.exprs import normal, normal_cdf, normal_pdf, uniform
from seqspark.functions.storage import pinned

LEAST_STD, LEAST_SPAN, RHO = 1e-12, 1e-12, 0.05

# Fixed values of the first objective: ranges that scores are clipped to, and its constants.
V1_RANGES = {
    "interface_dg": (-98.70550256759547, 17.115022472542762),
    "distance_score": (5.528944453683353, 7.361734707761549),
    "rosetta_score": (-1021.077541270006, 451.3142280816484),
    "sequence_pae": (3.430482456140357, 28.19067316394025),
    "iptm": (0.14, 0.95),
}
V1_DISTANCE, V1_ENERGY, V1_PAE = 3.0185924, 2.4250882, 1.2075188


def _gain(best: float, maximise: bool) -> Column:
    return (F.col("mean") - best) if maximise else (best - F.col("mean"))


def expected_improvement(best: float = 0.0, maximise: bool = True) -> Column:
    """Zero where the deviation is next to nothing."""
    gain, std = _gain(best, maximise), F.col("std")
    z = gain / std
    return F.when(std > LEAST_STD, gain * normal_cdf(z) + std * normal_pdf(z)).otherwise(0.0)


def probability_of_improvement(best: float = 0.0, maximise: bool = True) -> Column:
    return F.when(F.col("std") > LEAST_STD, normal_cdf(_gain(best, maximise) / F.col("std"))).otherwise(0.0)


def confidence_bound(kappa: float = 1.96, maximise: bool = True) -> Column:
    return F.col("mean") + (kappa if maximise else -kappa) * F.col("std")


def advance_best(predictions: DataFrame, maximise: bool = True) -> float | None:
    """The baseline of the next call: the best predicted mean of this one."""
    return predictions.agg((F.max if maximise else F.min)("mean")).first()[0]


def reference_points(predictions: DataFrame, directions: dict[str, str], state: DataFrame | None = None) -> DataFrame:
    """(obj, ideal, nadir) of the means where all objectives are minimised, widened by an earlier state."""
    signed = _minimised(predictions, directions)
    points = signed.groupBy("obj").agg(F.min("mean").alias("ideal"), F.max("mean").alias("nadir"))
    if state is None:
        return points
    return points.unionByName(state).groupBy("obj").agg(F.min("ideal").alias("ideal"), F.max("nadir").alias("nadir"))


def _minimised(predictions: DataFrame, directions: dict[str, str]) -> DataFrame:
    flips = F.lit(1.0)
    for obj, way in directions.items():
        flips = F.when(F.col("obj") == obj, -1.0 if way == "max" else 1.0).otherwise(flips)
    return predictions.withColumn("mean", F.col("mean") * flips)


def simplex_weights(n: int, seed: int = 42, call: int = 0) -> list[float]:
    """Random weights that sum to one, each at least 1e-6 before the last division, from the same uniforms as columns."""
    import hashlib

    u = [(int(hashlib.md5(f"{seed}|w|{call}|{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0 for i in range(n)]
    e = [-math.log(x) for x in u]
    w = [max(x / sum(e), 1e-6) for x in e]
    return [x / sum(w) for x in w]


def simplex_columns(names: list[str], *key: Column | str, seed: int = 42) -> list[Column]:
    """The same weights as columns, one for each name, from the uniforms of (w, key, place)."""
    e = [-F.ln(uniform(seed, F.lit("w"), *key, F.lit(i))) for i in range(len(names))]
    w = [F.greatest(x / sum(e[1:], e[0]), F.lit(1e-6)) for x in e]
    return [(x / sum(w[1:], w[0])).alias(n) for n, x in zip(names, w, strict=True)]


def scalarised(value: Column, weight: Column) -> Column:
    """Augmented Chebyshev value of normalised objectives, within a groupBy: the worst weighted one plus RHO times the sum."""
    return F.max(weight * value) + RHO * F.sum(weight * value)


def _normalised(predictions: DataFrame, directions: dict[str, str], weights: dict[str, float], points: DataFrame) -> DataFrame:
    """Signed rows with weight, ideal and span of their objective. There are as many points and weights as objectives, so they are literals."""
    out = _minimised(predictions, directions)
    ideal = span = weight = F.lit(None).cast("double")
    for r in points.collect():
        here = F.col("obj") == r["obj"]
        ideal = F.when(here, r["ideal"]).otherwise(ideal)
        span = F.when(here, max(r["nadir"] - r["ideal"], LEAST_SPAN)).otherwise(span)
        weight = F.when(here, weights[r["obj"]]).otherwise(weight)
    return out.select("*", ideal.alias("ideal"), span.alias("span"), weight.alias("weight"))


def scalarised_means(predictions: DataFrame, directions: dict[str, str], weights: dict[str, float], points: DataFrame | None = None) -> DataFrame:
    """(seq_id, value): augmented Chebyshev value of the means, scaled by ideal and nadir where objectives are minimised."""
    rows = _normalised(predictions, directions, weights, points if points is not None else reference_points(predictions, directions))
    return rows.groupBy("seq_id").agg(scalarised((F.col("mean") - F.col("ideal")) / F.col("span"), F.col("weight")).alias("value"))


def parego_ucb(predictions: DataFrame, directions: dict[str, str], weights: dict[str, float], kappa: float = 1.0, points: DataFrame | None = None) -> DataFrame:
    """(seq_id, acquisition): minus the scalarised optimistic point, mean - kappa * std where objectives are minimised."""
    rows = _normalised(predictions, directions, weights, points if points is not None else reference_points(predictions, directions))
    value = (F.col("mean") - kappa * F.col("std") - F.col("ideal")) / F.col("span")
    return rows.groupBy("seq_id").agg((-scalarised(value, F.col("weight"))).alias("acquisition"))


def parego_ei(predictions: DataFrame, directions: dict[str, str], weights: dict[str, float], draws: int = 256, seed: int = 42, points: DataFrame | None = None) -> DataFrame:
    """(seq_id, acquisition): mean improvement of ``draws`` scalarised draws over the best scalarised mean.

    Predictions are stored once for all passes. Objectives of a row become its columns and a draw is a compiled row that is summed where it is made, so neither arrays of draws nor draws are shuffled.
    """
    predictions = pinned(predictions)
    rows = _normalised(predictions, directions, weights, points if points is not None else reference_points(predictions, directions))
    means = rows.groupBy("seq_id").agg(scalarised((F.col("mean") - F.col("ideal")) / F.col("span"), F.col("weight")).alias("g"), F.count("*").alias("n"))
    best, most = means.agg(F.min("g"), F.max("n")).first()
    if best is None:
        return means.select("seq_id", F.lit(0.0).alias("acquisition"))
    parts, places = ("obj", "mean", "std", "ideal", "span", "weight"), range(most)
    own = rows.groupBy("seq_id").agg(F.collect_list(F.struct(*parts)).alias("o"))
    own = own.select("seq_id", F.size("o").alias("n"), *(F.get("o", F.lit(i))[c].alias(f"{c}{i}") for i in places for c in parts))
    drawn = own.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    z = lambda i: F.col(f"weight{i}") * (F.col(f"mean{i}") + F.col(f"std{i}") * normal(seed, F.col("seq_id"), F.col(f"obj{i}"), F.col("j")) - F.col(f"ideal{i}")) / F.col(f"span{i}")
    drawn = drawn.select("seq_id", "n", *(F.when(F.col("n") > i, z(i)).alias(f"z{i}") for i in places))
    total = sum((F.when(F.col("n") > i, F.col(f"z{i}")).otherwise(0.0) for i in places), F.lit(0.0))
    worst = F.greatest(*(f"z{i}" for i in places)) if most > 1 else F.col("z0")
    gain = F.greatest(F.lit(0.0), F.lit(best) - (worst + RHO * total))
    return drawn.groupBy("seq_id").agg((F.sum(gain) / draws).alias("acquisition"))


SINGLE: dict[str, Callable[..., Column]] = {
    "expected_improvement": expected_improvement, "upper_confidence_bound": confidence_bound, "probability_of_improvement": probability_of_improvement,
    "standard_deviation": lambda: F.col("std"), "mean": lambda: F.col("mean"),
}
MULTI = {"parego_chebyshev_ei": parego_ei, "parego_chebyshev_ucb": parego_ucb}


def acquisition(predictions: DataFrame, name: str, **how) -> DataFrame:
    """Values by name: for (seq_id, mean, std) an ``acquisition`` column, for (seq_id, obj, mean, std) one row for each seq_id."""
    multi = "obj" in predictions.columns
    known = MULTI if multi else SINGLE
    if name not in known:
        raise ValueError(f"no acquisition called {name} for {'several objectives' if multi else 'one objective'}; there are {', '.join(sorted(known))}")
    return known[name](predictions, **how) if multi else predictions.withColumn("acquisition", known[name](**how))


def _clipped(name: str) -> Column:
    lo, hi = V1_RANGES[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(name) - lo) / (hi - lo)))


def objective_v1() -> Column:
    """Product of an energy part and a confidence part of clipped scores; -1 outside the binding site."""
    energy = -_clipped("rosetta_score") - (_clipped("distance_score") + V1_DISTANCE) * (_clipped("interface_dg") - V1_ENERGY)
    confidence = -_clipped("iptm") * (_clipped("sequence_pae") - V1_PAE)
    return F.when(F.col("in_binding_site"), energy * confidence).otherwise(-1.0)


def objective_v0(scores: DataFrame, weights: dict[str, float], inverted: list[str], key: str = "seq_id") -> DataFrame:
    """(key, objective): weighted sum of scores scaled to [0.1, 1] over the batch; inverted ones first change sign; 0 outside the site. A constant score scales to 0.1."""
    value = {c: (-F.col(c) if c in inverted else F.col(c)) for c in weights}
    bounds = scores.agg(*(f(v).alias(f"{n}_{c}") for c, v in value.items() for n, f in (("lo", F.min), ("hi", F.max))))
    rows = scores.crossJoin(F.broadcast(bounds))  # one row of bounds
    scaled = {c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 0.1 + 0.9 * (v - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.1) for c, v in value.items()}
    total = sum((F.lit(float(w)) * scaled[c] for c, w in weights.items()), F.lit(0.0))
    return rows.select(key, F.when(F.col("in_binding_site"), total).otherwise(0.0).alias("objective"))


def scores_long(scores: DataFrame, columns: list[str], key: str = "seq_id") -> DataFrame:
    """(key, obj, value) of the named scores."""
    return scores.select(key, *columns).unpivot([key], columns, "obj", "value")


def create_objective(scores: DataFrame, function: Callable[..., DataFrame | Column], key: str = "seq_id", **how) -> DataFrame:
    """(key, objective) by a user's function of the scores, which gives a table or a column."""
    out = function(scores, **how)
    return out if isinstance(out, DataFrame) else scores.select(key, out.alias("objective"))


def iptm_minus_pae(scores: DataFrame) -> Column:
    return F.col("iptm") - F.col("sequence_pae") / 30
