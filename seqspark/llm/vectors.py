"""Blocks of vectors: what exact and approximate search share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import map_file, scratch, write_file, written
from seqspark.operators.order import ranked

PACKED = "block long, n int, uri string"


def valid_vectors(df: DataFrame, zero_too: bool = True) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part in a search, and ``row``, a number of each in the order of vec_id, where an id has several vectors.

    Left out are rows without id, null vectors, vectors with null or non-finite components (or all zero, unless ``zero_too``), and those
    whose length isn't the most frequent one (the larger of two as frequent), as products of different lengths mean nothing. A row that repeats both id and
    vector is one row; rows that share an id alone are different ones.
    """
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = x.where("vec_id is not null and vector is not null and size(vector) > 0").where(F.forall("vector", good))
    if not zero_too:
        x = x.where(F.exists("vector", lambda c: c != 0))
    length = x.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = x.where(F.size("vector") == (length["d"] if length else 0))
    if x.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return x
    x = written(x.distinct().withColumn("_n", F.monotonically_increasing_id()), scratch(df.sparkSession, "vectors"))
    if x.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return x.drop("_n")
    return ranked(x, scratch(df.sparkSession, "rows"), ("vec_id", True), ("_n", True)).select("vec_id", "vector", F.col("rank").cast("long").alias("row"))


def by_row(df: DataFrame) -> DataFrame:
    """(vec_id, vector) with the rows' numbers for ids, where rows have them."""
    return df.select(F.col("row" if "row" in df.columns else "vec_id").alias("vec_id"), "vector")


def by_name(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """What a search by :func:`by_row` found, with ids again."""
    if "row" not in vectors.columns:
        return found
    names = vectors.select("row", F.col("vec_id").alias("name"))
    for column in ("query_id", "vec_id"):
        found = found.join(names.withColumnRenamed("row", column), column).drop(column).withColumnRenamed("name", column)
    return found.select("query_id", "rank", "vec_id", "score")


def packed(df: DataFrame, block: Column, folder: str, bound: bool = False) -> DataFrame:
    """(vec_id, vector[, bound]) rows as one file for each block: ids, row-major float64 matrix, bounds. Blocks are kept small by the caller.

    Returns a written table (block, n, uri), so what pairs of blocks carry through a shuffle are names, never vectors.
    """

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        matrix = np.array(rows["vector"].tolist(), np.float64)
        head = np.array(matrix.shape, np.int64)
        uri = write_file(f"{folder}/files", f"block-{key[0]}", [head.tobytes(), rows["vec_id"].to_numpy(np.int64).tobytes(), matrix.tobytes(), rows["bound"].to_numpy(np.float64).tobytes()])
        return pd.DataFrame([{"block": key[0], "n": len(rows), "uri": uri}])

    rows = df.select(block.cast("long").alias("block"), "vec_id", "vector", (F.col("bound") if bound else F.lit(float("-inf"))).alias("bound"))
    return written(rows.groupBy("block").applyInPandas(pack, PACKED), f"{folder}/blocks")


def unpacked(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, matrix and bounds of a block's file, mapped where it can be."""
    data = map_file(uri)
    n, d = (int(x) for x in data[:16].view(np.int64))
    ids, rest = data[16 : 16 + 8 * n].view(np.int64), data[16 + 8 * n :].view(np.float64)
    return ids, rest[: n * d].reshape(n, d), rest[n * d :]


def distinct_vectors(ids: np.ndarray, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows; for each the ``most`` smallest ids that have it, as a flat array and the number of each. No more can be among the best ``most`` of a block."""
    _, first, inverse = np.unique(np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    of = inverse[order]
    start = np.searchsorted(of, np.arange(len(first)))
    keep = np.arange(len(of)) - start[of] < most
    return matrix[first], ids[order[keep]], np.bincount(of[keep], minlength=len(first))


def each_pair(pairs: DataFrame, n_pairs: int, search: Callable[[str, str], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``search`` on every pair (left, right) of files. Pairs are dealt evenly over tasks, which hold one at a time; those with one left file follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left, right in zip(b["left"], b["right"], strict=True):
                yield search(left, right)

    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pairs // 64)
    dealt = pairs.select("left", "right").repartition(max(1, min(parts, n_pairs)), "left", "right").sortWithinPartitions("left", "right")
    return dealt.mapInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
