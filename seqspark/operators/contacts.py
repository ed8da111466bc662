"""Contacts between chains by cells of a grid: an equi-join on cells, then the exact distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.storage import pinned


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def near_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of atoms of one structure within ``cutoff``: columns l_* and r_* and the distance d.

    Points are in cells as wide as the cutoff; each right atom (give the smaller side) is repeated in the 27 cells around its own, so a pair
    meets in exactly one cell, and no pair beyond neighbouring cells is formed.
    """
    cells = lambda df: df.select("*", *(_cell(c, cutoff).alias(f"c{c}") for c in "xyz"))
    rename = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    r = rename(cells(right), "r")
    for c in "xyz":
        r = r.withColumn(f"r_c{c}", F.explode(F.array(*(F.col(f"r_c{c}") + k for k in (-1, 0, 1)))))
    a = rename(cells(left), "l")
    on = (F.col("l_structure_id") == F.col("r_structure_id")) & (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy")) & (F.col("l_cz") == F.col("r_cz"))
    d = F.sqrt(sum(((F.col(f"l_{c}") - F.col(f"r_{c}")) * (F.col(f"l_{c}") - F.col(f"r_{c}")) for c in "yz"), (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x"))))
    return a.join(r, on).withColumn("d", d).where(F.col("d") <= cutoff).drop("l_cx", "l_cy", "l_cz", "r_cx", "r_cy", "r_cz")


def chain_contacts(atoms: DataFrame, receptor: str, sequence: str, cutoff: float) -> DataFrame:
    return near_pairs(atoms.where(F.col("chain") == receptor), atoms.where(F.col("chain") == sequence), cutoff)


def distance_score(atoms: DataFrame, receptor: str = "A", sequence: str = "B", cutoff: float = 8.0) -> DataFrame:
    """(structure_id, n_receptor, distance_score): mean over receptor atoms with a sequence atom within ``cutoff`` of the distance to the nearest; infinite without any, 0 if a chain is missing."""
    nearest = chain_contacts(atoms, receptor, sequence, cutoff).groupBy(F.col("l_structure_id").alias("structure_id"), F.col("l_res_idx")).agg(F.min("d").alias("d"))
    scores = nearest.groupBy("structure_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    chains = atoms.groupBy("structure_id").agg(F.count_if(F.col("chain") == receptor).alias("a"), F.count_if(F.col("chain") == sequence).alias("b"))
    value = F.when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(F.coalesce("mean", F.lit(float("inf"))))
    return chains.join(scores, "structure_id", "left").select("structure_id", F.coalesce("n", F.lit(0)).alias("n_receptor"), value.alias("distance_score"))


def binding_sites(atoms: DataFrame, receptor: str = "A", sequence: str = "B", cutoff: float = 5.0) -> DataFrame:
    """(structure_id, receptor_site, sequence_site): sorted residue indices of either side that are in contact."""
    pairs = chain_contacts(atoms, receptor, sequence, cutoff)
    indices = lambda c: F.array_sort(F.collect_set(c))
    return pairs.groupBy(F.col("l_structure_id").alias("structure_id")).agg(indices("l_res_idx").alias("receptor_site"), indices("r_res_idx").alias("sequence_site"))


def in_site(atoms: DataFrame, site: DataFrame, required: int = 1, receptor: str = "A", sequence: str = "B", cutoff: float = 5.0) -> DataFrame:
    """(structure_id, n_in_site, in_site): receptor residues in contact that are of ``site`` (structure_id, res_idx), and whether they are ``required`` or more."""
    touched = chain_contacts(atoms, receptor, sequence, cutoff).select(F.col("l_structure_id").alias("structure_id"), F.col("l_res_idx").alias("res_idx")).distinct()
    hits = touched.join(site, ["structure_id", "res_idx"], "left_semi").groupBy("structure_id").agg(F.count("*").alias("n"))
    all_ids = atoms.select("structure_id").distinct()
    n = F.coalesce("n", F.lit(0))
    return all_ids.join(hits, "structure_id", "left").select("structure_id", n.alias("n_in_site"), (n >= required).alias("in_site"))


def centroid_proximity(atoms: DataFrame, site: DataFrame, cutoff: float = 10.0, receptor: str = "A", sequence: str = "B") -> DataFrame:
    """(structure_id, centroid_distance, near): distance between the centroids of the site's atoms and of the sequence chain."""
    centre = lambda df, p: df.groupBy("structure_id").agg(*(F.avg(c).alias(p + c) for c in "xyz"))
    a = centre(atoms.where(F.col("chain") == receptor).join(site, ["structure_id", "res_idx"], "left_semi"), "a")
    b = centre(atoms.where(F.col("chain") == sequence), "b")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    return a.join(b, "structure_id").select("structure_id", d.alias("centroid_distance"), (d <= cutoff).alias("near"))


def nearest_distances(points: DataFrame, others: DataFrame, first: float = 4.0) -> DataFrame:
    """(structure_id, res_idx, d): the distance of each residue of ``points`` (structure_id, res_idx, x, y, z) to the nearest of ``others`` (structure_id, x, y, z) of its structure, however far.

    Rings of cells grow: residues that have one within ``first`` are done, the rest look within twice that, and so on, so pairs are only formed with what is about as near as the
    nearest. Residues of structures without others have no row; points that aren't finite are left out.
    """
    finite = reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in "xyz"))
    others = pinned(others.where(finite).select("structure_id", "x", "y", "z"))
    left = points.where(finite).select("structure_id", "res_idx", "x", "y", "z").join(others.select("structure_id").distinct(), "structure_id", "left_semi")
    found, radius = None, first
    while True:
        near = near_pairs(left, others, radius).groupBy(F.col("l_structure_id").alias("structure_id"), F.col("l_res_idx").alias("res_idx")).agg(F.min("d").alias("d"))
        near = pinned(near)
        found = near if found is None else found.unionByName(near)
        left, radius = pinned(left.join(near, ["structure_id", "res_idx"], "left_anti")), 2 * radius
        if left.isEmpty():
            return found


def smooth_site_score(atoms: DataFrame, site: DataFrame, threshold: float = 5.0, alpha: float = 1.0, receptor: str = "A", sequence: str = "B") -> DataFrame:
    """(structure_id, smooth_score): mean over site residues of a logistic of the distance to the nearest sequence atom, found by growing rings of cells."""
    a = atoms.where(F.col("chain") == receptor).join(site, ["structure_id", "res_idx"], "left_semi")
    nearest = nearest_distances(a, atoms.where(F.col("chain") == sequence), threshold)
    return nearest.groupBy("structure_id").agg(F.avg(1 / (1 + F.exp(alpha * (F.col("d") - threshold)))).alias("smooth_score"))


def weighted_plddt(plddt: DataFrame, residues: DataFrame, atoms: DataFrame, receptor: str = "A", sequence: str = "B", cutoff: float = 5.0) -> DataFrame:
    """(structure_id, weighted_plddt): mean over the sequence's residues of their pLDDT where in contact, else 0."""
    hits = chain_contacts(atoms, receptor, sequence, cutoff).select(F.col("r_structure_id").alias("structure_id"), F.col("r_res_idx").alias("res_idx")).distinct().withColumn("hit", F.lit(True))
    rows = residues.where(F.col("chain") == sequence).join(plddt, ["structure_id", "token_idx"]).join(hits, ["structure_id", "res_idx"], "left")
    return rows.groupBy("structure_id").agg(F.avg(F.when(F.col("hit"), F.col("plddt")).otherwise(0.0)).alias("weighted_plddt"))
