"""All requested scores of complexes from their structures and metrics: atoms and contacts are worked out once, and every family of scores reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.functions.storage import pinned
from seqspark.operators.contacts import near_pairs
from seqspark.operators.structure import with_residue_index
from seqspark.sources import readers

CONTACTS = ("distance_score", "n_contacts", "n_in_site", "in_binding_site", "weighted_plddt")
METRICS = ("iptm", "ptm", "sequence_plddt", "sequence_pae", "weighted_plddt")
PROPERTIES = {"length": properties.length, "molecular_weight": properties.molecular_weight, "gravy": properties.gravy}
SCORES = tuple(dict.fromkeys((*CONTACTS, *METRICS, *PROPERTIES)))


def _token_metrics(metrics: DataFrame, residues: DataFrame, sequence: str) -> DataFrame:
    """(structure_id, res_idx, plddt, pae) of the sequence's residues; pae is the mean of its row. Each array is taken apart once."""
    rows = metrics.select("structure_id", F.posexplode(F.arrays_zip("plddt", F.transform("pae", lambda r: F.try_divide(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), F.size(r).cast("double"))).alias("error"))).alias("token_idx", "t"))
    own = residues.where(F.upper("chain") == sequence.upper()).select("structure_id", "token_idx", "res_idx")
    return rows.join(own, ["structure_id", "token_idx"]).select("structure_id", "res_idx", F.col("t.plddt").alias("plddt"), F.col("t.error").alias("pae"))


def complex_scores(atoms: DataFrame, metrics: DataFrame, wanted: list[str], site: DataFrame | None = None, receptor: str = "A", sequence: str = "B", reach: float = 8.0, touch: float = 5.0, required: int = 1) -> DataFrame:
    """structure_id and the ``wanted`` scores of every structure, by name; an unknown name, or one that needs a site where there is none, is an error.

    ``atoms`` are those of readers (of the first model), ``metrics`` (structure_id, iptm, ptm, plddt, pae), ``site`` (structure_id, res_idx). Structures without metrics have null there.
    Distances are between CA atoms within ``reach``, contacts between any atoms within ``touch``; both come out of one search of neighbours.
    """
    if unknown := [w for w in wanted if w not in SCORES]:
        raise ValueError(f"no scores called {', '.join(unknown)}; there are {', '.join(SCORES)}")
    if site is None and (needy := [w for w in wanted if w in ("n_in_site", "in_binding_site")]):
        raise ValueError(f"{', '.join(needy)} need a site")
    rows = pinned(with_residue_index(atoms.where(F.col("model") == 0)).select("structure_id", "chain", "res_seq", "icode", "resname", "model", "hetflag", "line_no", "atom_name", "res_idx", "x", "y", "z"))
    residues = readers.residues(rows)
    families: list[DataFrame] = []
    on = lambda *names: any(n in wanted for n in names)
    if on(*CONTACTS):
        point = lambda chain: rows.where(F.col("chain") == chain).select("structure_id", "res_idx", "atom_name", "x", "y", "z")
        near = near_pairs(point(receptor), point(sequence), max(reach, touch)).select(F.col("l_structure_id").alias("structure_id"), F.col("l_res_idx").alias("a"), F.col("r_res_idx").alias("b"), "d", (F.col("l_atom_name") == "CA").alias("l_ca"), (F.col("r_atom_name") == "CA").alias("r_ca"))
        # One row for each pair of residues that are near; all families read these.
        backbone = F.min(F.when(F.col("l_ca") & F.col("r_ca") & (F.col("d") <= reach), F.col("d"))).alias("d_ca")
        pairs = pinned(near.groupBy("structure_id", "a", "b").agg(backbone, F.min("d").alias("d")))
        touching = pairs.where(F.col("d") <= touch)
        if on("distance_score"):
            nearest = pairs.where("d_ca is not null").groupBy("structure_id", "a").agg(F.min("d_ca").alias("d"))
            both = rows.groupBy("structure_id").agg(F.count_if(F.col("chain") == receptor).alias("n_a"), F.count_if(F.col("chain") == sequence).alias("n_b"))
            value = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise(F.coalesce("mean", F.lit(float("inf"))))
            families.append(both.join(nearest.groupBy("structure_id").agg(F.avg("d").alias("mean")), "structure_id", "left").select("structure_id", value.alias("distance_score")))
        if on("n_contacts", "n_in_site", "in_binding_site"):
            touched = touching.select("structure_id", F.col("a").alias("res_idx")).distinct()
            flagged = touched.join(site.select("structure_id", "res_idx", F.lit(1).alias("own")), ["structure_id", "res_idx"], "left") if site is not None else touched.withColumn("own", F.lit(None).cast("int"))
            families.append(flagged.groupBy("structure_id").agg(F.count("*").alias("n_contacts"), F.count("own").alias("n_in_site")))
    if on("sequence_plddt", "sequence_pae", "weighted_plddt"):
        tokens = pinned(_token_metrics(metrics, residues, sequence))
        plain = tokens.groupBy("structure_id").agg(F.avg("plddt").alias("sequence_plddt"), F.avg("pae").alias("sequence_pae"))
        families.append(plain)
        if on("weighted_plddt"):
            hits = touching.select("structure_id", F.col("b").alias("res_idx"), F.lit(True).alias("hit")).distinct()
            families.append(tokens.join(hits, ["structure_id", "res_idx"], "left").groupBy("structure_id").agg(F.avg(F.when(F.col("hit"), F.col("plddt")).otherwise(0.0)).alias("weighted_plddt")))
    if on("iptm", "ptm"):
        families.append(metrics.select("structure_id", "iptm", "ptm"))
    if on(*PROPERTIES):
        own = readers.chain_sequences(rows).where(F.col("chain") == sequence)
        families.append(own.select("structure_id", *(f(F.col("sequence")).alias(n) for n, f in PROPERTIES.items())))
    out = rows.select("structure_id").distinct()
    for f in families:
        out = out.join(f, "structure_id", "left")
    return out.select("structure_id", *(_filled(w, required).alias(w) for w in wanted))


def _filled(name: str, required: int) -> Column:
    n = F.coalesce("n_in_site", F.lit(0)) if name == "in_binding_site" else None
    return n >= required if n is not None else F.coalesce(name, F.lit(0)) if name in ("n_contacts", "n_in_site") else F.col(name)
