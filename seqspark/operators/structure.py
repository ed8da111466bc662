"""Lookups in tables of atoms: (structure_id, model, line_no, hetflag, chain, res_seq, icode, resname, atom_name, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators.filters import standard_residues
from seqspark.sources import readers


def chain_atoms(atoms: DataFrame, chain: str, atom_name: str | None = None) -> DataFrame:
    """All atoms of a chain, or those of one name, with ``pos``, their place in file order from 0."""
    rows = standard_residues(atoms).where(F.col("chain") == chain)
    if atom_name is not None:
        rows = rows.where(F.col("atom_name") == atom_name)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("structure_id").orderBy("model", "line_no")) - 1)


def chain_coordinates(atoms: DataFrame, chain: str, atom_name: str = "CA") -> DataFrame:
    """(structure_id, coordinates): points of a chain's atoms of one name, in file order."""
    point = F.struct("pos", *(F.col(c) for c in "xyz"))
    ordered = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(*(p[c].alias(c) for c in "xyz")))
    return chain_atoms(atoms, chain, atom_name).groupBy("structure_id").agg(ordered.alias("coordinates"))


def atoms_by_residue(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain, res_seq, atoms): a map from atom name to point for each residue; of atoms with one name the first."""
    first = standard_residues(atoms).groupBy("structure_id", "chain", "res_seq", "atom_name").agg(F.min_by(F.struct("x", "y", "z"), "line_no").alias("point"))
    return first.groupBy("structure_id", "chain", "res_seq").agg(F.map_from_entries(F.collect_list(F.struct("atom_name", "point"))).alias("atoms"))


def residue_coordinates(atoms: DataFrame, places: DataFrame, chain: str = "A") -> DataFrame:
    """(structure_id, res_idx, x, y, z) of a chain's atoms at the places (structure_id, res_idx), counted from 0."""
    rows = atoms.where(F.col("chain") == chain)
    return rows.join(places, ["structure_id", "res_idx"], "left_semi").select("structure_id", "res_idx", "x", "y", "z")


def first_residues(residues: DataFrame) -> DataFrame:
    """(structure_id, chain, start): number of each chain's first residue."""
    return residues.groupBy("structure_id", "chain").agg(F.min_by("res_seq", "token_idx").alias("start"))


def design_sequences(atoms: DataFrame, sample: Column | None = None) -> DataFrame:
    """(structure_id, chain, sequence) of chain A, or of the first chain where there is no A; a residue that is none of the 20 is X. ``sample`` adds sample_id."""
    order = Window.partitionBy("structure_id").orderBy(F.when(F.col("chain") == "A", 0).otherwise(1), "chain")
    chains = readers.chain_sequences(atoms).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return chains.select("structure_id", "chain", "sequence", *([] if sample is None else [sample.alias("sample_id")]))


def with_residue_index(atoms: DataFrame) -> DataFrame:
    """Atoms with res_idx, their residue's place in its chain."""
    index = readers.residues(atoms).select("structure_id", "chain", "res_seq", "icode", "res_idx")
    return standard_residues(atoms).join(index, ["structure_id", "chain", "res_seq", "icode"])
