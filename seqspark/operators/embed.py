"""Embeddings: property averages, scaling, pooling and principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.functions.storage import pinned


def property_columns(s: Column, table: dict[str, dict[str, float]]) -> list[Column]:
    """Mean of each property over the letters, in the order of its name; unknown letters count as 0. ``table`` is property -> letter -> value."""
    means = property_means(s, table)
    return [means[i].alias(name) for i, name in enumerate(sorted(table))]


def property_means(s: Column, table: dict[str, dict[str, float]]) -> Column:
    """The same as one array; letters of a batch are counted once for all properties. Null for a null or empty sequence. Letters of ``table`` are A to Z."""
    values = np.stack([properties._table(table[name]) for name in sorted(table)], axis=1)

    def means(a: pa.Array) -> pa.Array:
        code, at = properties._letters(a)
        out, length = properties.letter_counts(code, at) @ values, np.diff(at)
        flat = (out / np.maximum(length, 1)[:, None]).ravel()
        ends = np.concatenate([[0], np.cumsum(np.where(length > 0, values.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(flat[np.repeat(length > 0, values.shape[1])]), mask=pa.array(length == 0))

    return F.arrow_udf(means, "array<double>")(s)


def with_stored(rows: DataFrame, embeddings: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows with their embedding from a table that was made elsewhere; rows without one are dropped."""
    return rows.join(embeddings.select(key, "embedding"), key)


def regrouped(residues: DataFrame, key: str = "sequence") -> DataFrame:
    """(key, embedding) of residue rows (key, pos, embedding): an array of each residue's, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "embedding")))
    return residues.groupBy(key).agg(F.transform(ordered, lambda x: x["embedding"]).alias("embedding"))


def average_embedding(sequences: DataFrame, table: dict[str, dict[str, float]], key: str = "sequence", only_good: bool = False) -> DataFrame:
    """(key, embedding); with ``only_good`` of the sequences that pass the quality filter."""
    if only_good:
        from seqspark.operators.filters import quality_filter

        sequences = quality_filter(sequences, column=key)
    return sequences.select(key, F.array(*property_columns(F.col(key), table)).alias("embedding"))


def residue_embedding(sequences: DataFrame, table: dict[str, dict[str, float]], key: str = "sequence") -> DataFrame:
    """(key, pos, embedding) for each letter."""
    names = sorted(table)
    rows = sequences.where(F.length(key) > 0).select(key, F.posexplode(F.split(key, "")).alias("pos", "aa"))
    return rows.select(key, "pos", F.array(*(_of_letter(table[n], F.col("aa")) for n in names)).alias("embedding"))


def _of_letter(values: dict[str, float], letter: Column) -> Column:
    """The value of a letter, 0 for others; of capitals from an array, which is one step."""
    if all(len(a) == 1 and "A" <= a <= "Z" for a in values):
        found = F.get(F.array(*(F.lit(float(values.get(chr(65 + i), 0.0))) for i in range(26))), F.ascii(letter) - 65)
    else:
        found = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[letter]
    return F.coalesce(found, F.lit(0.0))


def residue_arrays(sequences: DataFrame, table: dict[str, list[float]], other: list[float], key: str = "sequence") -> DataFrame:
    """(key, embedding) with an array of the numbers of each letter, in order, of sequences that aren't empty: what :func:`regrouped` gives for residue rows, without a row for each letter. ``table`` is letter (A to Z) -> numbers."""
    numbers = np.array([table.get(chr(65 + i), other) for i in range(26)] + [other], float)

    def arrays(a: pa.Array) -> pa.Array:
        code, at = properties._letters(a)
        inner = np.arange(0, (len(code) + 1) * numbers.shape[1], numbers.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(at.astype(np.int32), pa.ListArray.from_arrays(inner, pa.array(numbers[code].ravel())))

    return sequences.where(F.length(key) > 0).select(key, F.arrow_udf(arrays, "array<array<double>>")(F.col(key)).alias("embedding"))


def pooled(residues: DataFrame, key: str = "sequence", size: int | None = None) -> DataFrame:
    """Mean over the residues of each sequence. With ``size``, the number of dimensions, in one aggregation without a row for each."""
    if size is not None:
        means = residues.groupBy(key).agg(*(F.avg(F.get("embedding", F.lit(i))).alias(f"_{i}") for i in range(size)))
        return means.select(key, F.array(*(f"_{i}" for i in range(size))).alias("embedding"))
    rows = residues.select(key, F.posexplode("embedding").alias("dim", "v")).groupBy(key, "dim").agg(F.avg("v").alias("v"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("embedding"))


def scaler(embeddings: DataFrame) -> DataFrame:
    """(dim, mean, std) with the deviation of the population, 0 counting as 1."""
    std = F.stddev_pop("v")
    return embeddings.select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


def scaled(embeddings: DataFrame, fitted: DataFrame) -> DataFrame:
    """Embeddings less the mean, over the deviation. ``fitted`` has a row for each dimension and becomes two literals."""
    rows = fitted.orderBy("dim").collect()
    if not rows:
        raise ValueError("the scaler isn't fitted")
    mean, std = (F.array(*(F.lit(float(r[c])) for r in rows)) for c in ("mean", "std"))
    return embeddings.withColumn("embedding", F.zip_with(F.zip_with("embedding", mean, lambda x, m: x - m), std, lambda x, s: x / s))


class Components:
    """Principal components of centred embeddings; the sign of each is such that its largest loading is positive."""

    def __init__(self, mean: list[float], axes: list[list[float]], explained: list[float]):
        self.mean, self.axes, self.explained = mean, axes, explained

    @classmethod
    def fit(cls, embeddings: DataFrame, n: int | None = None, ratio: float | None = None, size: int | None = None) -> Components:
        """By number, or as many as explain ``ratio`` of the variance. The covariance is one aggregation of the size of dimensions squared.

        With ``size``, a number of dimensions of up to 16 that every row has, one pass is enough and nothing is stored."""
        if size is not None and size <= 16:
            e = embeddings.select(*(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)))
            pairs = [(i, j) for i in range(size) for j in range(i, size)]
            got = e.agg(F.count("*").alias("n"), *(F.avg(f"e{i}").alias(f"m{i}") for i in range(size)), *(F.covar_pop(f"e{i}", f"e{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
            if not got["n"]:
                return cls([], [], [])
            covariance = np.zeros((size, size))
            for i, j in pairs:
                covariance[i, j] = covariance[j, i] = got[f"c{i}_{j}"] * got["n"] / max(got["n"] - 1, 1)
            return cls._of(np.array([got[f"m{i}"] for i in range(size)], float), covariance, n, ratio)
        e = pinned(embeddings.select(F.col("embedding").cast("array<double>").alias("e")))  # three passes read it
        d = e.select(F.max(F.size("e"))).first()[0] or 0
        one = e.select(F.posexplode("e").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.count("*").alias("n")).toPandas().sort_values("i")
        mean, count = one["m"].to_numpy(float), int(one["n"].max()) if d else 0
        shifted = F.zip_with("e", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
        pairs = e.select(shifted.alias("e")).select("e", F.posexplode("e").alias("i", "v")).select("i", F.transform("e", lambda x: x * F.col("v")).alias("row"))
        sums = pairs.groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(d))).alias("row")).toPandas().sort_values("i")
        return cls._of(mean, np.array(sums["row"].tolist(), float).reshape(d, d) / max(count - 1, 1), n, ratio)

    @classmethod
    def _of(cls, mean: np.ndarray, covariance: np.ndarray, n: int | None, ratio: float | None) -> Components:
        value, axes = np.linalg.eigh(covariance)
        value, axes = np.maximum(value[::-1], 0), axes[:, ::-1].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        share = value / max(value.sum(), 1e-300)
        if ratio is not None:
            n = int(np.searchsorted(np.cumsum(share), ratio - 1e-12) + 1)
        return cls(mean.tolist(), axes[:n].tolist(), share[:n].tolist())

    def transform(self, embeddings: DataFrame) -> DataFrame:
        d = len(self.mean)
        if self.axes and d <= 16:  # few numbers are compiled, without a lambda for each
            at = [F.get("_e", F.lit(i)) - F.lit(m) for i, m in enumerate(self.mean)]
            moved = F.array(*(sum((F.lit(float(a)) * x for a, x in zip(axis, at, strict=True)), F.lit(0.0)) for axis in self.axes))
            rows = embeddings.withColumn("_e", F.col("embedding").cast("array<double>"))
            return rows.withColumn("embedding", F.when(F.size("_e") == d, moved).otherwise(F.array(*(F.lit(None).cast("double") for _ in self.axes)))).drop("_e")
        centred = F.zip_with(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, self.mean)), lambda x, m: x - m)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        # One product for each axis, not a lambda over axes: within a lambda the embedding would be worked out anew for each.
        moved = [dot(F.array(*map(F.lit, a)), F.col("embedding")) for a in self.axes]
        return embeddings.withColumn("embedding", centred).withColumn("embedding", F.array(*moved).cast("array<double>"))

    def of_letters(self, table: dict[str, dict[str, float]]) -> tuple[dict[str, list[float]], list[float]]:
        """Components of single letters, and of one that is in no table: those of a residue depend on its letter alone."""
        names, axes, mean = sorted(table), np.array(self.axes).reshape(-1, len(self.mean)), np.array(self.mean)
        own = lambda a: (axes @ (np.array([float(table[n].get(a, 0.0)) for n in names]) - mean)).tolist()
        return {a: own(a) for a in set().union(*table.values())}, own("")
