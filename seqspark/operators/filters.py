"""Filters and checks of candidate sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions.exprs import ALPHABET, count_letter


def quality_filter(df: DataFrame, most_share: float = 0.75, most_run: int = 5, shorter_than: int = 30, longer_than: int = 5, column: str = "sequence") -> DataFrame:
    """Upper-cased sequences of the 20 letters, with lengths strictly between the bounds, no letter over ``most_share`` of them and no run over ``most_run``."""
    s = F.col(column)
    share = F.greatest(*(count_letter(s, a) for a in ALPHABET)) / F.length(s)
    rows = df.withColumn(column, F.upper(s))
    return rows.where((F.length(s) > longer_than) & (F.length(s) < shorter_than)).where(s.rlike(f"^[{ALPHABET}]+$")).where(share <= most_share).where(~s.rlike(rf"(.)\1{{{most_run},}}"))


def split_by_alphabet(df: DataFrame, column: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """Rows whose sequence is of the 20 letters, and the rest (null included)."""
    good = F.coalesce(F.col(column).rlike(f"^[{ALPHABET}]+$"), F.lit(False))
    return df.where(good), df.where(~good)


def not_evaluated(candidates: DataFrame, evaluated: DataFrame, key: str = "sequence") -> DataFrame:
    """Candidates whose key is among no evaluated row."""
    return candidates.join(evaluated.select(key).distinct(), key, "left_anti")


def with_previous(candidates: DataFrame, previous: DataFrame, process, key: str = "sequence") -> DataFrame:
    """Results for all candidates: those of before, and ``process`` of what is new."""
    return previous.unionByName(process(not_evaluated(candidates, previous, key)), allowMissingColumns=True)


def standard_residues(atoms: DataFrame) -> DataFrame:
    """Atoms that are of residues, not of water or other molecules."""
    return atoms.where(~F.col("hetflag"))


def structure_subset(atoms: DataFrame, chains: list[str] | None = None, first_model: bool = False, residues: tuple[int, int] | None = None, strip: bool = False) -> DataFrame:
    """Atoms of the named chains, of the first model, within inclusive residue numbers, without water and ligands."""
    out = atoms
    if chains is not None:
        out = out.where(F.col("chain").isin(chains))
    if first_model:
        first = out.groupBy("structure_id").agg(F.min("model").alias("model"))
        out = out.join(first, ["structure_id", "model"], "left_semi")
    if residues is not None:
        out = out.where(F.col("res_seq").between(*residues))
    return standard_residues(out) if strip else out


def normalised_sites(sites: DataFrame, chains: DataFrame, zero_indexed: bool = False) -> DataFrame:
    """(structure_id, res_idx) as one-based places. ``chains`` has structure_id, n_residues and start; an index outside the chain is an error, checked before the shift."""
    joined = sites.join(chains, "structure_id")
    inside = F.col("res_idx").between(F.lit(0) if zero_indexed else F.lit(1), F.col("n_residues") - (1 if zero_indexed else 0))
    shifted = F.when(F.lit(zero_indexed) & (F.col("start") != 0), F.col("res_idx") - F.col("start")).otherwise(F.col("res_idx")) + F.lit(1 if zero_indexed else 0)
    return joined.select("structure_id", F.when(inside, shifted).otherwise(F.raise_error(F.lit("a binding-site index lies outside its chain")).cast("int")).alias("res_idx"))


def site_windows(sites: DataFrame, residues: DataFrame, around: int = 5) -> DataFrame:
    """(structure_id, site_idx, context): letters from ``around`` before to ``around`` after each site, the site's in brackets."""
    places = sites.select("structure_id", F.col("res_idx").alias("site_idx"), F.explode(F.sequence(F.col("res_idx") - around, F.col("res_idx") + around)).alias("res_idx"))
    letter = F.when(F.col("res_idx") == F.col("site_idx"), F.concat(F.lit("["), F.col("aa"), F.lit("]"))).otherwise(F.col("aa"))
    near = places.join(residues, ["structure_id", "res_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("res_idx", letter.alias("aa"))))
    return near.groupBy("structure_id", "site_idx").agg(F.array_join(F.transform(ordered, lambda x: x["aa"]), "").alias("context"))


def same_length(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: how many embeddings there are, of how many lengths, and whether that is one."""
    return embeddings.agg(F.count("*").alias("n"), F.count_distinct(F.size(column)).alias("lengths")).withColumn("consistent", F.col("lengths") <= 1)


def consistent_objectives(objectives: DataFrame) -> DataFrame:
    """One row: number of keys, of distinct sets of objective names, and whether that is one."""
    names = objectives.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_set("obj")), ",").alias("names"))
    return names.agg(F.count("*").alias("n"), F.count_distinct("names").alias("kinds")).withColumn("consistent", F.col("kinds") <= 1)


def without_failures(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows that didn't fail, with the error column dropped."""
    return rows.where(F.col(error).isNull()).drop(error)
