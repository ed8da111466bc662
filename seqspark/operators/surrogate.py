"""Uncertainty-aware regression: the data are summed into small matrices by Spark, and only those are solved on the driver.

Rows have seq_id, embedding (array<double>) and y; several objectives add obj. Predictions have seq_id, mean and std.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.exprs import uniform
from seqspark.operators.order import first_filter, share


def _array(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class HiddenLayer:
    """Fixed random projections with a rectifier, and a constant: features that make linear models nonlinear.

    Layers of one seed are nested: the units of a narrower one are the first of a wider one.
    """

    weights: np.ndarray | None
    bias: np.ndarray | None

    @classmethod
    def of(cls, dimension: int, width: int, seed: int = 42) -> HiddenLayer:
        if not width:
            return cls(None, None)
        weights = np.random.default_rng([seed, 0]).standard_normal((width, dimension)) * np.sqrt(2 / dimension)
        return cls(weights, np.random.default_rng([seed, 1]).uniform(-1, 1, width))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """The features of the rows of a matrix."""
        units = [] if self.weights is None else [np.maximum(x @ self.weights.T + self.bias, 0.0)]
        return np.concatenate([np.ones((len(x), 1)), x, *units], axis=1)

    def features(self, embedding: Column) -> Column:
        e = embedding.cast("array<double>")
        if self.weights is None:
            return F.concat(F.array(F.lit(1.0)), e)
        units = F.array(*(F.struct(_array(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(self.weights, self.bias, strict=True)))
        return F.concat(F.array(F.lit(1.0)), e, F.transform(units, lambda u: F.greatest(F.lit(0.0), dot(u["w"], e) + u["b"])))


def gram(rows: DataFrame, features: Column, y: Column, weight: Column | None = None, by: list[str] = []) -> list[tuple]:  # noqa: B006
    """(key, X'WX, X'Wy, y'Wy, sum W) for each group: one aggregation, partial sums before the shuffle, results of the size of features squared."""
    w = F.lit(1.0) if weight is None else weight
    x = rows.select(*by, F.concat(features, F.array(y)).alias("x"), w.alias("w"))
    long = x.select(*by, "x", "w", F.posexplode("x").alias("i", "v"))
    d = rows.select(F.max(F.size(F.concat(features, F.array(y))))).first()[0]
    if d is None:
        return []
    got = long.groupBy(*by, "i").agg(F.array(*(F.sum(F.col("w") * F.col("v") * F.col("x")[j]) for j in range(d))).alias("row"), F.sum("w").alias("w")).collect()
    out: dict[tuple, np.ndarray] = {}
    total: dict[tuple, float] = {}
    for r in got:
        key = tuple(r[b] for b in by)
        out.setdefault(key, np.zeros((d, d)))[r["i"]] = r["row"]
        total[key] = r["w"]
    return [(k, m[:-1, :-1], m[:-1, -1], m[-1, -1], total[k]) for k, m in sorted(out.items(), key=lambda kv: str(kv[0]))]


@dataclass
class BayesianRegression:
    """Conjugate normal-inverse-gamma regression: mean, aleatoric and epistemic variance."""

    layer: HiddenLayer
    mean: np.ndarray
    precision: np.ndarray
    a: float
    b: float

    @classmethod
    def solve(cls, layer: HiddenLayer, xx: np.ndarray, xy: np.ndarray, yy: float, n: float, ridge: float = 1.0) -> BayesianRegression:
        prior = ridge * np.eye(len(xx))
        prior[0, 0] = 1e-6
        precision = xx + prior
        mean = np.linalg.solve(precision, xy)
        return cls(layer, mean, precision, 1 + n / 2, 1e-6 + max(0.5 * float(yy - mean @ precision @ mean), 0.0))

    @property
    def noise(self) -> float:
        return self.b / (self.a - 1) if self.a > 1 else self.b

    def components(self, df: DataFrame) -> DataFrame:
        """df with mean, aleatoric, epistemic and total variance."""
        f = self.layer.features(F.col("embedding"))
        root = np.linalg.cholesky(np.linalg.inv(self.precision) + 1e-12 * np.eye(len(self.mean))).T
        spread = F.aggregate(F.transform(F.array(*map(_array, root)), lambda r: dot(r, F.col("_x"))), F.lit(0.0), lambda s, x: s + x * x)
        noise = self.noise
        out = df.withColumn("_x", f).withColumn("mean", dot(_array(self.mean), F.col("_x"))).withColumn("aleatoric", F.lit(float(noise)))
        return out.withColumn("epistemic", noise * spread).withColumn("total", F.col("aleatoric") + F.col("epistemic")).drop("_x")

    def predict(self, df: DataFrame, mode: str = "total") -> DataFrame:
        return self.components(df).withColumn("std", F.sqrt(F.col(mode))).drop("aleatoric", "epistemic", "total")


@dataclass
class WeightDraws:
    """Several weight vectors; mean and sample deviation of what they predict. Serves ensembles and posterior draws alike."""

    layer: HiddenLayer
    weights: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        each = F.transform(F.array(*map(_array, self.weights)), lambda w: dot(w, F.col("_x")))
        n = len(self.weights)
        out = df.withColumn("_x", self.layer.features(F.col("embedding"))).withColumn("_p", each)
        out = out.withColumn("mean", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x) / n)
        square = F.aggregate("_p", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
        return out.withColumn("std", F.sqrt(square / max(n - 1, 1))).drop("_x", "_p")


@dataclass
class MeanVariance:
    """One regression for the mean and one for the log of the squared residual, held within 10 of zero."""

    mean_model: BayesianRegression
    log_variance: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        lv = dot(_array(self.log_variance), self.mean_model.layer.features(F.col("embedding")))
        out = self.mean_model.predict(df).drop("std")
        return out.withColumn("std", F.exp(0.5 * F.greatest(F.lit(-10.0), F.least(F.lit(10.0), lv))))


def fit(rows: DataFrame, kind: str = "evidential", width: int = 0, ridge: float = 1.0, members: int = 10, seed: int = 42):
    """A model by name: evidential, ensemble, draws or mean_variance; an unknown name is an error."""
    first = rows.select(F.max(F.size("embedding"))).first()[0]
    if first is None:
        raise ValueError("no rows to learn from")
    layer = HiddenLayer.of(int(first), width, seed)
    f, y = layer.features(F.col("embedding")), F.col("y").cast("double")
    solve = lambda g: BayesianRegression.solve(layer, *g[1:], ridge=ridge)
    if kind == "evidential":
        return solve(gram(rows, f, y)[0])
    if kind == "draws":
        model = solve(gram(rows, f, y)[0])
        rng = np.random.default_rng(seed)
        root = np.linalg.cholesky(np.linalg.inv(model.precision) + 1e-12 * np.eye(len(model.mean)))
        noise = np.sqrt(model.b / max(model.a - 1, 1e-9))
        return WeightDraws(layer, model.mean + noise * (rng.standard_normal((members, len(model.mean))) @ root.T))
    if kind == "ensemble":
        # Every row counts Poisson(1) times for each member, by the uniform of its key.
        from seqspark.operators.generate import poisson

        each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
        times = poisson(F.lit(1.0), uniform(seed, "seq_id", "member")).cast("double")
        return WeightDraws(layer, np.array([solve(g).mean for g in gram(each, f, y, times, ["member"])]))
    if kind == "mean_variance":
        model = solve(gram(rows, f, y)[0])
        residual = model.predict(rows).withColumn("lr", F.greatest(F.lit(-10.0), F.ln((F.col("y") - F.col("mean")) ** 2 + 1e-10)))
        g = gram(residual, f, F.col("lr"))[0]
        return MeanVariance(model, BayesianRegression.solve(layer, *g[1:], ridge=ridge).mean + np.eye(len(g[2]))[0] * 1.27)  # E[ln chi2_1] = -1.27
    raise ValueError(f"no surrogate called {kind}")


def fit_each(rows: DataFrame, width: int = 0, ridge: float = 1.0, seed: int = 42) -> dict[str, BayesianRegression]:
    """One model for each objective, from one aggregation."""
    layer = HiddenLayer.of(int(rows.select(F.max(F.size("embedding"))).first()[0]), width, seed)
    return {g[0][0]: BayesianRegression.solve(layer, *g[1:], ridge=ridge) for g in gram(rows, layer.features(F.col("embedding")), F.col("y").cast("double"), by=["obj"])}


def predict_each(models: dict[str, BayesianRegression], df: DataFrame) -> DataFrame:
    """(seq_id, obj, mean, std), objectives by name."""
    out = None
    for obj in sorted(models):
        part = models[obj].predict(df.select("seq_id", "embedding")).select("seq_id", F.lit(obj).alias("obj"), "mean", "std")
        out = part if out is None else out.unionByName(part)
    return out


def split(rows: DataFrame, validation: float | int, least: int = 2, seed: int = 42) -> DataFrame:
    """Rows with ``validation``: true for a share or number of them, those of least uniform; for none where either part would be below ``least``."""
    n = rows.count()
    k = share(n, validation) if isinstance(validation, float) else validation
    if k < least or n - k < least:
        return rows.withColumn("validation", F.lit(False))
    dealt = rows.withColumn("_u", uniform(seed, "seq_id"))
    taken, tied, _ = first_filter(dealt, k, ("_u", True), ("seq_id", True))
    return dealt.withColumn("validation", taken | tied).drop("_u")


def train_with_validation(rows: DataFrame, kind: str = "evidential", validation: float | int = 0.2, seed: int = 42, **how):
    """A model and one row of its metrics (mse, mae, r2) as train_ and val_ columns. Where the table is too small to be split, all rows train and val_ is null."""
    from seqspark.operators.metrics import fit_metrics

    dealt = split(rows, validation, seed=seed)
    model = fit(dealt.where("not validation").drop("validation"), kind, seed=seed, **how)
    scored = model.predict(dealt).select(F.when(F.col("validation"), "val").otherwise("train").alias("obj"), "y", "mean")
    measured = fit_metrics(scored).where("obj is not null")
    columns = [F.max(F.when(F.col("obj") == part, F.col(m))).alias(f"{part}_{m}") for part in ("train", "val") for m in ("mse", "mae", "r2")]
    return model, measured.agg(*columns)


def trial_table(ids: DataFrame, widths: tuple[int, ...] = (0, 16, 32), ridges: tuple[float, float] = (1e-3, 1e2), seed: int = 42, earlier: DataFrame | None = None, again: int = 5) -> DataFrame:
    """(trial, width, ridge, origin): a random search over the ids (trial), widths alike and ridges log-uniform, by the uniform of each id.

    The best ``again`` of ``earlier`` trials (trial, width, ridge, nll) are tried once more, before the fresh ones; trials whose nll is null weren't finished.
    """
    lo, hi = (math.log10(r) for r in ridges)
    at = (1 + F.floor(uniform(seed, "trial", F.lit("width")) * len(widths))).cast("int")
    ridge = F.pow(F.lit(10.0), lo + (hi - lo) * uniform(seed, "trial", F.lit("ridge")))
    fresh = ids.select(F.col("trial").cast("long").alias("trial"), F.element_at(F.array(*map(F.lit, widths)), at).alias("width"), ridge.alias("ridge"), F.lit("fresh").alias("origin"))
    if earlier is None:
        return fresh
    best = earlier.where("nll is not null").orderBy("nll", "trial").limit(again)
    return best.select(F.col("trial").cast("long").alias("trial"), F.col("width").cast("int").alias("width"), F.col("ridge").cast("double").alias("ridge"), F.lit("again").alias("origin")).unionByName(fresh)


def cross_validate(rows: DataFrame, trials: list[dict], folds: int = 5, seed: int = 42) -> DataFrame:
    """(trial, nll): mean over folds of the Gaussian negative log-likelihood of the left-out fold. Trials (in their order) differ in width and ridge.

    As layers are nested, one aggregation of the widest features in each fold holds the sums of every trial and fold; these are solved, and
    one pass scores all rows by all trials of their fold. The number of jobs doesn't depend on trials or folds. What travels to the tasks has
    trials x folds x features squared numbers.
    """
    spark, most = rows.sparkSession, max((t["width"] for t in trials), default=0)
    dealt = rows.withColumn("fold", F.floor(uniform(seed, "seq_id") * folds).cast("int"))
    dimension = rows.select(F.max(F.size("embedding"))).first()[0]
    if dimension is None or not trials:
        return spark.createDataFrame([], "trial int, nll double")
    layer = HiddenLayer.of(int(dimension), most, seed)
    grams = {g[0][0]: g[1:] for g in gram(dealt, layer.features(F.col("embedding")), F.col("y").cast("double"), by=["fold"])}
    whole = [sum(g[i] for g in grams.values()) for i in range(4)]
    solved = {}
    for fold, g in grams.items():
        xx, xy, yy, n = (w - x for w, x in zip(whole, g, strict=True))
        for k, t in enumerate(trials):
            size = 1 + int(dimension) + t["width"]
            m = BayesianRegression.solve(layer, xx[:size, :size], xy[:size], yy, n, ridge=t["ridge"])
            solved[fold, k] = m.mean, np.linalg.cholesky(np.linalg.inv(m.precision) + 1e-12 * np.eye(size)), m.noise
    sent, floor = spark.sparkContext.broadcast((layer, solved)), 1e-6

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer, solved = sent.value
        total: dict[tuple[int, int], list[float]] = {}
        for b in batches:
            fold, y = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            x = layer.matrix(np.asarray(b.column(1).flatten(), float).reshape(len(y), -1))
            for f in np.unique(fold).tolist():
                own = fold == f
                for k in range(len(trials)):
                    mean, root, noise = solved[f, k]
                    xs = x[own, : len(mean)]
                    std = np.maximum(np.sqrt(noise * (1 + ((xs @ root) ** 2).sum(1))), floor)
                    nll = 0.5 * (((y[own] - xs @ mean) / std) ** 2 + 2 * np.log(std) + math.log(2 * math.pi))
                    sums = total.setdefault((k, f), [0.0, 0])
                    sums[0], sums[1] = sums[0] + float(nll.sum()), sums[1] + int(own.sum())
        yield pa.RecordBatch.from_pylist([{"trial": k, "fold": f, "total": s, "n": n} for (k, f), (s, n) in total.items()], schema=pa.schema([("trial", pa.int32()), ("fold", pa.int32()), ("total", pa.float64()), ("n", pa.int64())]))

    sums = dealt.select("fold", F.col("embedding").cast("array<double>").alias("e"), F.col("y").cast("double").alias("y")).mapInArrow(score, "trial int, fold int, total double, n long")
    mean = F.sum("total") / F.sum("n")
    per_fold = sums.groupBy("trial", "fold").agg(F.when(F.isnan(mean) | (F.abs(mean) == float("inf")), 1e6).otherwise(mean).alias("nll"))
    return per_fold.groupBy("trial").agg(F.avg("nll").alias("nll"))


def tuned(rows: DataFrame, n_trials: int = 20, folds: int = 3, seed: int = 42, earlier: DataFrame | None = None, **space) -> tuple[dict, DataFrame]:
    """The best parameters (width, ridge, nll; ties to the earlier trial) and the table of all trials with their nll, which the next tuning can start from."""
    spark = rows.sparkSession
    drawn = trial_table(spark.range(n_trials).withColumnRenamed("id", "trial"), seed=seed, earlier=earlier, **space).collect()  # as few as the search has trials
    drawn = sorted(drawn, key=lambda r: (r["origin"], r["trial"]))
    found = dict(cross_validate(rows, [{"width": r["width"], "ridge": r["ridge"]} for r in drawn], folds, seed).collect())
    table = [(k, r["width"], r["ridge"], found.get(k)) for k, r in enumerate(drawn)]
    best = min((t for t in table if t[3] is not None), key=lambda t: (t[3], t[0]), default=(0, 0, 1.0, None))
    return {"width": best[1], "ridge": best[2], "nll": best[3]}, spark.createDataFrame(table, "trial int, width int, ridge double, nll double")
