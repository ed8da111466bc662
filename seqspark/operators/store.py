"""Fitted models as versioned tables: numbers are read back bit for bit, and a version that wasn't written whole doesn't count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from seqspark.operators.embed import Components
from seqspark.operators.surrogate import BayesianRegression, HiddenLayer, MeanVariance, WeightDraws

SCHEMA = "name string, kind string, part string, row int, numbers array<double>"


def _layer(layer: HiddenLayer) -> dict[str, np.ndarray]:
    return {} if layer.weights is None else {"layer_weights": layer.weights, "layer_bias": layer.bias}


def _parts(model) -> tuple[str, dict[str, np.ndarray]]:
    if isinstance(model, BayesianRegression):
        return "regression", {**_layer(model.layer), "mean": model.mean, "precision": model.precision, "shape": np.array([model.a, model.b])}
    if isinstance(model, WeightDraws):
        return "draws", {**_layer(model.layer), "weights": model.weights}
    if isinstance(model, MeanVariance):
        return "mean_variance", {**_parts(model.mean_model)[1], "log_variance": model.log_variance}
    if isinstance(model, Components):
        return "components", {"mean": np.array(model.mean), "axes": np.array(model.axes).reshape(len(model.axes), -1), "explained": np.array(model.explained)}
    if isinstance(model, dict):
        return "parameters", {k: np.array([float(v)]) for k, v in model.items() if v is not None}
    raise ValueError(f"a {type(model).__name__} can't be stored")


def _model(kind: str, parts: dict[str, np.ndarray]):
    one = lambda name: parts[name][0]
    layer = HiddenLayer(parts["layer_weights"], one("layer_bias")) if "layer_weights" in parts else HiddenLayer(None, None)
    if kind == "parameters":
        return {k: float(v[0, 0]) for k, v in parts.items()}
    if kind == "components":
        return Components(one("mean").tolist(), parts["axes"].tolist(), one("explained").tolist())
    if kind == "draws":
        return WeightDraws(layer, parts["weights"])
    regression = BayesianRegression(layer, one("mean"), parts["precision"], *map(float, one("shape")))
    return regression if kind == "regression" else MeanVariance(regression, one("log_variance"))


def save_models(spark: SparkSession, models: dict[str, object], path: str, version: int) -> None:
    """Writes named models (surrogates, components, parameters, or a scaler's table) as one version; writing it again replaces it.

    A model has as many numbers as features squared, so its rows come from the driver; a scaler (a DataFrame of dim, mean, std) is written as it is."""
    rows = []
    for name, model in sorted(models.items()):
        kind, parts = ("scaler", {"table": np.array([[r["dim"], r["mean"], r["std"]] for r in model.orderBy("dim").collect()], float)}) if isinstance(model, DataFrame) else _parts(model)
        rows += [(name, kind, part, i, [float(x) for x in line]) for part, numbers in parts.items() for i, line in enumerate(np.atleast_2d(np.asarray(numbers, float)))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written whole, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n.removeprefix("version=").isdigit() and whole(n))


def load_models(spark: SparkSession, path: str, version: int | None = None) -> dict[str, object]:
    """Models by name of a version, or of the last whole one; none where nothing is stored. A scaler is a table again."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return {}
    found: dict[str, tuple[str, dict[str, dict[int, list[float]]]]] = {}
    for r in spark.read.schema(SCHEMA).parquet(f"{path}/version={known[-1] if version is None else version}").collect():
        found.setdefault(r["name"], (r["kind"], {}))[1].setdefault(r["part"], {})[r["row"]] = r["numbers"]
    out: dict[str, object] = {}
    for name, (kind, parts) in found.items():
        arrays = {part: np.array([lines[i] for i in sorted(lines)], float) for part, lines in parts.items()}
        out[name] = spark.createDataFrame([(int(d), float(m), float(s)) for d, m, s in arrays["table"]], "dim int, mean double, std double") if kind == "scaler" else _model(kind, arrays)
    return out
