"""Exact order statistics of whole tables: counts narrow the place of the k-th row down, and a filter takes what lies before it.

Nothing is sorted as a whole and no task holds more than ``SMALL`` values, however large the share that is asked for.
"""

from __future__ import annotations

import math
import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many values are left to the driver to sort; more are narrowed down further.
SMALL = 10_000
_STEPS = 10_000


def _of_numbers(x: DataFrame, k: int, m: int):
    """The k-th least of ``m`` numbers ``x``, and how many lie below it. Each round keeps the numbers strictly between two of them that enclose the place."""
    below, lo, hi, stuck = 0, None, None, False
    while True:
        inside = [c for c in (F.col("x") > lo if lo is not None else None, F.col("x") < hi if hi is not None else None) if c is not None]
        rows = x.where(reduce(Column.__and__, inside)) if inside else x
        if m <= SMALL:
            values = sorted(r[0] for r in rows.collect())
            v = values[k - below - 1]
            return v, below + values.index(v)
        p = (k - below - 0.5) / m
        if stuck:  # numbers beyond the precision of the sketch: halve their range
            least, most = rows.agg(F.min("x"), F.max("x")).first()
            a = b = (least + most) // 2 if isinstance(least, int) else least / 2 + most / 2
        else:
            a, b = rows.agg(F.percentile_approx("x", [max(0.0, p - 3 / _STEPS), min(1.0, p + 3 / _STEPS)], _STEPS)).first()[0]
        counts = rows.agg(*(F.count_if(c) for c in (F.col("x") < a, F.col("x") <= a, F.col("x") < b, F.col("x") <= b))).first()
        lt_a, le_a, lt_b, le_b = (below + n for n in counts)
        was = m
        if k <= lt_a:
            hi, m = a, lt_a - below
        elif k <= le_a:
            return a, lt_a
        elif k <= lt_b:
            lo, hi, m, below = a, b, lt_b - le_a, le_a
        elif k <= le_b:
            return b, lt_b
        else:
            lo, m, below = b, m - (le_b - below), le_b
        stuck = m == was


def _of_texts(x: DataFrame, k: int, m: int):
    """The k-th text by code points, and how many lie before it. Each round lengthens the prefix by what all have in common and one letter more."""
    below, prefix = 0, ""
    while True:
        rows = x.where(F.col("x").startswith(prefix)) if prefix else x
        if m <= SMALL:
            values = sorted(r[0] for r in rows.collect())
            v = values[k - below - 1]
            return v, below + values.index(v)
        first, last = rows.agg(F.min("x"), F.max("x")).first()
        if first == last:
            return first, below
        prefix = os.path.commonprefix([first, last])
        n = len(prefix)
        for letter, count in sorted(rows.groupBy(F.substring("x", n + 1, 1)).count().collect()):
            if k <= below + count:
                break
            below += count
        if not letter:
            return prefix, below
        prefix, m = prefix + letter, count


def _kth(df: DataFrame, column: str, k: int, m: int, ascending: bool):
    x = df.where(_known(df, column)).select(F.col(column).alias("x"))
    search = _of_texts if isinstance(df.schema[column].dataType, T.StringType) else _of_numbers
    if ascending:
        v, before = search(x, k, m)
        return v, before
    v, below = search(x, m - k + 1, m)
    return v, m - below - x.where(F.col("x") == F.lit(v)).count()


def _known(df: DataFrame, column: str) -> Column:
    known = F.col(column).isNotNull()
    return known & ~F.isnan(column) if isinstance(df.schema[column].dataType, T.FractionalType) and not isinstance(df.schema[column].dataType, T.DecimalType) else known


def first_filter(df: DataFrame, k: int, *order: tuple[str, bool]) -> tuple[Column, Column, int]:
    """What the first ``k`` rows meet in the order of numeric or text columns, each given as (name, ascending): a condition of rows that
    are among them, one of rows that are alike in all columns at the last place, and how many of these belong to them (0 where the first condition says all).

    Nulls and NaN come last in either direction. Conditions are never null. ``df`` is read a few times for each column, so an expensive one is best stored before.
    """
    taken, tied, left = F.lit(False), F.lit(True), k
    if k <= 0:
        return taken, F.lit(False), 0
    for column, ascending in order:
        rows, known = df.where(tied), _known(df, column)
        total, m = rows.agg(F.count("*"), F.count_if(known)).first()
        if total <= left:
            return taken | tied, F.lit(False), 0
        if left <= m:
            v, before = _kth(rows, column, left, m, ascending)
            ahead = F.col(column) < F.lit(v) if ascending else F.col(column) > F.lit(v)
            taken = taken | (tied & known & F.coalesce(ahead, F.lit(False)))
            tied, left = tied & known & F.coalesce(F.col(column) == F.lit(v), F.lit(False)), left - before
        else:
            taken = taken | (tied & known)
            tied, left = tied & ~known, left - m
    if df.where(tied).count() <= left:
        return taken | tied, F.lit(False), 0
    return taken, tied, left


def first_rows(df: DataFrame, k: int, *order: tuple[str, bool]) -> DataFrame:
    """The first ``k`` rows in the order that :func:`first_filter` describes; of rows that are alike in all its columns at the last place any are taken."""
    taken, tied, left = first_filter(df, k, *order)
    rows = df.where(taken)
    return rows.unionByName(df.where(tied).limit(left)) if left else rows


def share(n: int, fraction: float) -> int:
    """The number of rows that a fraction of ``n`` is, downwards."""
    return math.floor(n * fraction)


def ranked(df: DataFrame, path: str, *order: tuple[str, bool]) -> DataFrame:
    """``df`` with ``rank`` from 1 in the given order, nulls and NaN last: the place within a range of the order and the sizes of earlier ranges.

    Ranges are written to ``path`` once, so that every later reading sees the same ones; sizes are a row for each range.
    """
    value = lambda c: F.when(_known(df, c), F.col(c))
    by = [value(c).asc_nulls_last() if up else value(c).desc_nulls_last() for c, up in order]
    df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    spark = df.sparkSession
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    before, starts = 0, []
    for r, n in sorted(rows.groupBy("_range").count().collect()):
        starts.append((r, before))
        before += n
    offsets = spark.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return rows.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")  # a row for each range
