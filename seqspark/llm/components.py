"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import discard, written


def parts_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def with_least(rows: DataFrame, key: str, value: str, salt: str) -> DataFrame:
    """``rows`` with ``least``, the smallest ``value`` of their ``key``; rows of one key are dealt over all partitions by ``salt``, so a key may have any share of them."""
    n = parts_of(rows)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int")).repartition(n, key, "_salt")
    part = dealt.groupBy(key, "_salt").agg(F.min(value).alias("least"))
    whole = part.groupBy(key).agg(F.min("least").alias("least"), F.collect_list("_salt").alias("salts"))
    return dealt.join(whole.select(key, "least", F.explode("salts").alias("_salt")), [key, "_salt"]).drop("_salt")


def salted_join(rows: DataFrame, few: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` on ``key``, where each key of ``few`` may be that of any share of ``rows``: a copy of each of the few meets every part of them."""
    n = parts_of(rows)
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, "u", "v", "v").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The smallest neighbour's own row becomes the node's link to it.
    return with_least(down, "u", "v", "v").select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node that links has one link, to a node that doesn't."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
    return odd.count() == 0


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root) for each node of an edge table (u, v), root being the component's smallest node.

    Large-star and small-star steps alternate until only stars are left, in O(log^2 n) rounds; each round is a written table, so
    lineage stays short and a lost executor costs one round at most. A hub's edges are dealt over all tasks. Loops (u = v) and repeated edges are allowed; an
    empty table has no components.
    """
    spark = edges.sparkSession
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at, k = written(down.distinct(), f"{path}/0"), 0
    while k == 1 or not _stars(at):  # one round is seldom enough
        k += 1
        at = written(_small(_large(at)), f"{path}/{k}")
        discard(spark, f"{path}/{k - 1}")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
