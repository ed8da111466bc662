"""Ranking, selection and set operations over candidates and results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.functions.exprs import distance, uniform
from seqspark.functions.storage import pinned
from seqspark.operators.order import first_rows, share


def leaderboard(objectives: DataFrame, n: int, maximise: bool = True, key: str = "sequence", value: str = "objective") -> DataFrame:
    """rank, key and value of the best n; ties by key. The window runs over n rows."""
    order = (F.desc if maximise else F.asc)(value)
    top = objectives.select(key, value).where(F.col(value).isNotNull()).orderBy(order, key).limit(n)
    return top.select(F.row_number().over(Window.orderBy(order, key)).alias("rank"), key, value)


def leaderboard_by_objective(objectives: DataFrame, n: int, directions: dict[str, str], key: str = "seq_id") -> DataFrame:
    """rank, obj, key and value of the best n of each objective; an unnamed objective is maximised."""
    sign = F.lit(-1.0)
    for obj, way in directions.items():
        sign = F.when(F.col("obj") == obj, 1.0 if way == "min" else -1.0).otherwise(sign)
    rank = F.row_number().over(Window.partitionBy("obj").orderBy(sign * F.col("value"), key))
    return objectives.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= n).select("rank", "obj", key, "value")


def top_by(df: DataFrame, column: str, n: int, key: str = "seq_id") -> DataFrame:
    return df.orderBy(F.desc(column), key).limit(n)


def latest_batch(log: DataFrame) -> DataFrame:
    """Rows of the last iteration."""
    last = log.agg(F.max("iteration").alias("iteration"))
    return log.join(F.broadcast(last), "iteration", "left_semi")  # one row


def random_rows(df: DataFrame, n: int, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """n rows without replacement, those with the least uniform of their key."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def share_or_number(top: float | int, n: int) -> int:
    """How many of n rows a share below 1 (one row at least) or a number stands for."""
    if top <= 0:
        raise ValueError("the top must be a positive share or number")
    return max(1, share(n, top)) if isinstance(top, float) and top < 1 else int(top)


def best_rows(objectives: DataFrame, n: int, key: str = "seq_id", value: str = "objective", maximise: bool = True) -> DataFrame:
    """The n best rows, ties by key, by the n-th value and a filter; n may be any share of the table."""
    return first_rows(objectives.where(F.col(value).isNotNull()), n, (value, not maximise), (key, True))


def parents(objectives: DataFrame, m: int, fraction: float | int = 0.2, seed: int = 42, key: str = "seq_id", value: str = "objective") -> DataFrame:
    """m random ones of the best share or number (of m rows at least)."""
    n_top = max(m, share_or_number(fraction, objectives.count()))
    return random_rows(best_rows(objectives, n_top, key, value), m, seed, key)


def top_of_any(objectives: DataFrame, top: float | int, directions: dict[str, str], key: str = "seq_id") -> DataFrame:
    """(key) of the rows (key, obj, value) that are among the best share or number of some objective; an unnamed objective is maximised."""
    counts = objectives.where("value is not null").groupBy("obj").count().orderBy("obj").collect()
    if not counts:
        return objectives.select(key).limit(0)
    n = share_or_number(top, objectives.select(key).distinct().count())
    parts = [best_rows(objectives.where(F.col("obj") == r["obj"]), n, key, "value", directions.get(r["obj"], "max") == "max").select(key) for r in counts]
    return reduce(DataFrame.unionByName, parts).distinct()


def parents_by_objective(objectives: DataFrame, m: int, n_top: float | int, directions: dict[str, str], seed: int = 42, key: str = "seq_id") -> DataFrame:
    """m random ones of those that are among the best ``n_top`` (a share or a number) of some objective."""
    return random_rows(top_of_any(objectives, n_top, directions, key), m, seed, key)


def _weighted_draw(rows: DataFrame, fitness: Column, m: int, beta: float, seed: int, key: str) -> DataFrame:
    """The m least of -ln(U) / w with w = exp(beta * fitness): distributed as m draws one after the other."""
    return rows.withColumn("_arrival", -F.ln(uniform(seed, key)) / F.exp(beta * fitness)).orderBy("_arrival", key).limit(m).drop("_arrival")


def exponential_parents(objectives: DataFrame, m: int, beta: float = 1.0, maximise: bool = True, seed: int = 42, key: str = "seq_id", value: str = "objective") -> DataFrame:
    """m rows without replacement with weights exp(beta * fitness), fitness being scaled to [0, 1] (0.5 if flat)."""
    v = F.col(value) if maximise else -F.col(value)
    bounds = objectives.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    fitness = F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return _weighted_draw(objectives.crossJoin(F.broadcast(bounds)), fitness, m, beta, seed, key).drop("_lo", "_hi")  # one row of bounds


def mean_fitness(objectives: DataFrame, directions: dict[str, str], key: str = "seq_id") -> DataFrame:
    """(key, fitness) of rows (key, obj, value): the mean over objectives of the value scaled to [0, 1] within its objective (0.5 if flat), turned round for those that are minimised.

    Bounds are a row for each objective; an unnamed objective is maximised."""
    rows = objectives.where("value is not null")
    bounds = rows.groupBy("obj").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    least = [o for o, way in directions.items() if way == "min"]
    turned = F.coalesce(F.when(F.col("obj").isin(least), 1 - scaled).otherwise(scaled) if least else scaled, F.lit(0.5))
    return rows.join(F.broadcast(bounds), "obj").groupBy(key).agg(F.avg(turned).alias("fitness"))  # as few rows as objectives


def exponential_parents_multi(objectives: DataFrame, m: int, directions: dict[str, str], beta: float = 1.0, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """(key, fitness): m rows without replacement with weights exp(beta * mean scaled fitness over objectives)."""
    return _weighted_draw(mean_fitness(objectives, directions, key), F.col("fitness"), m, beta, seed, key)


def adalead(objectives: DataFrame, kappa: float, batch: DataFrame | None = None, value: str = "objective") -> DataFrame:
    """Rows with at least (1 - kappa) times the best value of ``batch`` (default: of themselves)."""
    if not 0 <= kappa <= 1:
        raise ValueError("kappa must be between 0 and 1")
    best = (batch if batch is not None else objectives).agg(F.max(value).alias("best"))
    return objectives.crossJoin(F.broadcast(best)).where(F.col(value) >= (1 - kappa) * F.col("best")).drop("best")  # one row


def spread_picks(embeddings: DataFrame, n: int, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """n rows by sampling in proportion to the squared distance from the nearest pick, and no further refinement.

    One job for each pick; the distance column is renewed against one vector and cut from its lineage every ten picks.
    """
    rows = embeddings.select(key, "embedding").withColumn("near", F.lit(None).cast("double"))
    picked: list = []
    for i in range(n):
        arrival = F.when(F.col("near").isNull(), uniform(seed, key, F.lit(i))).when(F.col("near") > 0, -F.ln(uniform(seed, key, F.lit(i))) / F.col("near") ** 2)
        best = rows.where(~F.col(key).isin(picked) if picked else F.lit(True)).orderBy(arrival.asc_nulls_last(), key).first()
        if best is None:
            break
        picked.append(best[key])
        d = distance(F.col("embedding"), F.array(*map(F.lit, map(float, best["embedding"]))))
        rows = rows.withColumn("near", F.least("near", d))
        if i % 10 == 9:
            rows = pinned(rows)
    order = F.create_map(*(F.lit(x) for i, p in enumerate(picked) for x in (p, i + 1))) if picked else F.lit(None)
    return embeddings.where(F.col(key).isin(picked)).select(order[F.col(key)].alias("rank"), key) if picked else embeddings.select(F.lit(0).alias("rank"), key).limit(0)


def _nearer(rows: DataFrame, key: str, picks: list[tuple]) -> DataFrame:
    """Rows with ``near``, the distance to the nearest of all picks so far, and ``gain``, their value times that; the new ``picks`` (key, embedding) are taken out."""
    taken, points = {k for k, _ in picks}, np.array([e for _, e in picks], float)
    names = [key, "value", "embedding", "near", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column(3).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(2).flatten(), float).reshape(len(near), -1)
            for p in points:
                near = np.minimum(near, _distances(x, p))
            left = pa.array([k not in taken for k in b.column(0).to_pylist()], pa.bool_())
            value = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near), pa.array(value * near)], names=names).filter(left)

    return rows.select(*names).mapInArrow(run, rows.select(*names).schema)


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.sqrt((d * d).sum(1))


def greedy_batch(candidates: DataFrame, n: int, key: str = "seq_id", value: str = "acquisition", pool: int = 4096) -> DataFrame:
    """n rows: the best value first, then again and again the largest value times distance to the nearest pick. Ties by key.

    (key, value, embedding) in; rank and key out. Rows whose value is null or NaN are no candidates.

    Once there is a pick, gains of nonnegative values only fall, so a gain that isn't up to date is an upper bound. A round brings the ``pool`` rows of the
    largest gains to the driver, which picks among them, up to date, as long as the best of them is above all that stayed behind; then one pass
    brings all rows up to date. So rounds are far fewer than picks. Rows of negative value come when no others are left, one a pass, as their gains rise.
    """
    v = F.col(value).cast("double")
    rows = candidates.where(v.isNotNull() & ~F.isnan(v)).select(key, v.alias("value"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = pinned(rows.withColumn("near", F.lit(float("inf"))).withColumn("gain", F.lit(0.0)))
    best = rows.orderBy(F.desc("value"), key).select(key, "embedding").first() if n > 0 else None
    picked: list = []
    fresh = [] if best is None else [(best[key], best["embedding"])]
    while fresh:
        picked += [k for k, _ in fresh]
        if len(picked) >= n:
            break
        rows = pinned(_nearer(rows, key, fresh))
        upper, fresh = rows.where("value >= 0"), []
        near_top = first_rows(upper, pool, ("gain", False), (key, True)).select(key, "value", "embedding", "near").collect()  # at most ``pool`` rows
        if not near_top:
            last = rows.orderBy(F.desc("gain"), key).select(key, "embedding").first()
            fresh = [] if last is None else [(last[key], last["embedding"])]
            continue
        near_top.sort(key=lambda r: r[key])
        x, values, near = np.array([r["embedding"] for r in near_top], float), np.array([r["value"] for r in near_top]), np.array([r["near"] for r in near_top])
        behind, free = (values * near).min() if len(near_top) == pool else -1.0, np.ones(len(near_top), bool)
        while len(picked) + len(fresh) < n:
            gain = np.where(free, values * near, -1.0)
            i = int(gain.argmax())  # the first of the largest, and so that of the least key
            if gain[i] < 0 or (fresh and gain[i] <= behind):
                break
            fresh.append((near_top[i][key], near_top[i]["embedding"]))
            near = np.minimum(near, _distances(x, x[i]))
            free[i] = False
    schema = T.StructType([T.StructField("rank", T.IntegerType(), False), T.StructField(key, candidates.schema[key].dataType)])
    return candidates.sparkSession.createDataFrame([(i + 1, k) for i, k in enumerate(picked)], schema)


def newly_logged(objectives: DataFrame, logged: DataFrame, key: str = "seq_id") -> DataFrame:
    return objectives.join(logged.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "seq_id") -> DataFrame:
    """New rows stand for old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def union_candidates(local: DataFrame, elsewhere: DataFrame, key: str = "sequence") -> DataFrame:
    """Distinct candidates; the local row of a key stays."""
    both = local.withColumn("origin", F.lit("local")).unionByName(elsewhere.withColumn("origin", F.lit("global")))
    return both.groupBy(key).agg(F.max("origin").alias("origin"))


def common_keys(predictions: DataFrame, actual: DataFrame, key: str = "seq_id") -> DataFrame:
    return predictions.join(actual, key)


def with_roles(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    return scored.withColumn("role", F.lit("scored")).unionByName(candidates.withColumn("role", F.lit("candidate")))


def ranked_trials(trials: DataFrame, fresh: DataFrame, n: int = 5) -> DataFrame:
    """The n best finished trials again, with the new ones."""
    return trials.orderBy("score", "trial").limit(n).select("trial").unionByName(fresh.select("trial"))


def latest_rows(log: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order)))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
