"""Confidence scores from pLDDT vectors and pairwise error matrices in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_plddt(plddt: DataFrame, residues: DataFrame, chain: str = "B") -> DataFrame:
    """(structure_id, sequence_plddt): mean over a chain, whose name is matched without regard to case."""
    rows = residues.where(F.upper("chain") == chain.upper()).join(plddt, ["structure_id", "token_idx"])
    return rows.groupBy("structure_id").agg(F.avg("plddt").alias("sequence_plddt"))


def chain_error(matrix: DataFrame, residues: DataFrame, chain: str = "B", value: str = "pae") -> DataFrame:
    """(structure_id, sequence_error): mean of the chain's rows over all columns. ``matrix`` is (structure_id, i, j, value)."""
    rows = residues.where(F.col("chain") == chain).select("structure_id", F.col("token_idx").alias("i"))
    return matrix.join(rows, ["structure_id", "i"], "left_semi").groupBy("structure_id").agg(F.avg(value).alias("sequence_error"))


def d0(n: Column) -> Column:
    """Scale of the score for n residues, never below that of 27."""
    return 1.24 * F.pow(F.greatest(n, F.lit(27)) - 15, F.lit(1 / 3)) - 1.8


def chain_pair_scores(pae: DataFrame, residues: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """(structure_id, chain_1, chain_2, score, token_idx): for ordered pairs of chains the best residue's mean of 1 / (1 + (pae / d0)^2) over partners with an error below ``cutoff``; ties go to the first residue."""
    r = lambda p: residues.select("structure_id", F.col("token_idx").alias(p), F.col("chain").alias(f"chain_{p}"))
    rows = pae.where(F.col("pae") < cutoff).join(r("i"), ["structure_id", "i"]).join(r("j"), ["structure_id", "j"]).where("chain_i <> chain_j")
    per = Window.partitionBy("structure_id", "i", "chain_j")
    rows = rows.withColumn("n", F.count("*").over(per)).withColumn("s", 1 / (1 + F.pow(F.col("pae") / d0(F.col("n")), F.lit(2.0))))
    by_residue = rows.groupBy("structure_id", "chain_i", "chain_j", "i").agg(F.avg("s").alias("s"))
    best = F.max(F.struct("s", (-F.col("i")).alias("k")))
    out = by_residue.groupBy("structure_id", "chain_i", "chain_j").agg(best.alias("b"))
    return out.select("structure_id", F.col("chain_i").alias("chain_1"), F.col("chain_j").alias("chain_2"), F.col("b.s").alias("score"), (-F.col("b.k")).alias("token_idx"))


def chain_pair_bounds(scores: DataFrame) -> DataFrame:
    """(structure_id, chain_a, chain_b, largest, least, direction) of both directions of each pair; equal ones count as first to second."""
    a, b = F.least("chain_1", "chain_2"), F.greatest("chain_1", "chain_2")
    forward = F.max(F.when(F.col("chain_1") < F.col("chain_2"), F.col("score")))
    backward = F.max(F.when(F.col("chain_1") > F.col("chain_2"), F.col("score")))
    return scores.groupBy("structure_id", a.alias("chain_a"), b.alias("chain_b")).agg(F.max("score").alias("largest"), F.min("score").alias("least"), F.when(F.coalesce(forward, F.lit(-1.0)) >= F.coalesce(backward, F.lit(-1.0)), "forward").otherwise("backward").alias("direction"))


def monomer_confidence(structures: DataFrame) -> DataFrame:
    """structure_id, mean_plddt, ptm, mean_pae of array columns plddt and pae (array of arrays) and a number ptm; null where empty."""
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))
    return structures.select("structure_id", mean(F.col("plddt")).alias("mean_plddt"), "ptm", mean(F.flatten("pae")).alias("mean_pae"))
