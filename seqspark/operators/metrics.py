"""Fit metrics, losses and summaries as single aggregations. Rows have y, mean and std."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lanczos' approximation of the gamma function, g = 7 (Numerical Recipes; Godfrey 2001).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x > 0.5."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def fit_metrics(rows: DataFrame) -> DataFrame:
    """obj, mse, mae, r2: one row for each objective and one, with obj null, of the means over objectives. r2 is null where y doesn't vary."""
    centre = rows.groupBy("obj").agg(F.avg("y").alias("centre"))
    d, e = F.col("y") - F.col("mean"), F.col("y") - F.col("centre")
    per = rows.join(F.broadcast(centre), "obj").groupBy("obj").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), (1 - F.try_divide(F.sum(d * d), F.sum(e * e))).alias("r2"))  # as few rows as objectives
    overall = per.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2")).select(F.lit(None).cast("string").alias("obj"), "mse", "mae", "r2")
    return per.unionByName(overall)


def gaussian_nll(y: Column, mean: Column, std: Column) -> Column:
    """Mean negative log-likelihood, deviations being 1e-6 at least; what isn't finite counts as 1e6."""
    s = F.greatest(std, F.lit(1e-6))
    value = F.avg(0.5 * (((y - mean) / s) ** 2 + 2 * F.ln(s) + math.log(2 * math.pi)))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 1e6).otherwise(value)


def multi_nll(rows: DataFrame) -> DataFrame:
    """One row, nll: mean over objectives of each row, then over rows."""
    s = F.greatest("std", F.lit(1e-6))
    value = 0.5 * (((F.col("y") - F.col("mean")) / s) ** 2 + 2 * F.ln(s) + math.log(2 * math.pi))
    return rows.groupBy("seq_id").agg(F.avg(value).alias("v")).agg(F.avg("v").alias("nll"))


def evidential_loss(y: Column, gamma: Column, v: Column, alpha: Column, beta: Column, weight: float = 0.1) -> Column:
    """Mean of the negative log evidence of a normal-inverse-gamma and ``weight`` times |error| (2 v + alpha)."""
    omega = 2 * beta * (1 + v)
    nll = 0.5 * F.ln(math.pi / v) - alpha * F.ln(omega) + (alpha + 0.5) * F.ln((y - gamma) ** 2 * v + omega) + log_gamma(alpha) - log_gamma(alpha + 0.5)
    return F.avg(nll + weight * F.abs(y - gamma) * (2 * v + alpha))


def mean_variance_loss(y: Column, mean: Column, log_variance: Column, weight: float = 0.01) -> Column:
    """Mean of half the log variance (within 10 of zero) plus half the squared error over the variance, and a charge on small variances."""
    lv = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), log_variance))
    return F.avg(0.5 * (lv + (y - mean) ** 2 * F.exp(-lv))) + weight * F.avg(-lv)


def calibration(rows: DataFrame) -> DataFrame:
    """One row: share of rows within two deviations, and the root mean squared error."""
    z = F.abs(F.col("y") - F.col("mean")) / F.col("std")
    return rows.agg(F.avg(F.when(z <= 2, 1.0).otherwise(0.0)).alias("within_two"), F.sqrt(F.avg((F.col("y") - F.col("mean")) ** 2)).alias("rmse"))


def search_space(candidates: DataFrame, scores: DataFrame, key: str = "seq_id") -> DataFrame:
    """One row: candidates, evaluated and remaining ones, longest embedding."""
    done = scores.select(key).distinct().withColumn("done", F.lit(1))
    rows = candidates.join(done, key, "left")
    return rows.agg(F.count("*").alias("n_candidates"), F.count("done").alias("n_evaluated"), F.count_if(F.col("done").isNull()).alias("n_remaining"), F.max(F.size("embedding")).cast("long").alias("input_dim"))
