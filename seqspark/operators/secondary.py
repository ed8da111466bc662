"""Secondary structure from backbone atoms: hydrogen bonds by energy, then turns, bridges and ladders (Kabsch and Sander 1983, in the three-state form)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators.contacts import near_pairs
from seqspark.operators.filters import standard_residues

BACKBONE = ("N", "CA", "C", "O")
# Charges times the unit factor (kcal/mol), the energy of a bond, and the length of N-H.
COUPLING, BOND_ENERGY, NH = 0.084 * 332, -0.5, 1.01
#: Beyond this distance of O and N no energy is as low as that of a bond, for C=O lengths of up to 1.3.
REACH = 12.0


def _difference(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]


def _length(v: list[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, (x * x for x in v)))


def _hydrogen() -> Column:
    """The point off N half-way between the directions away from the C before it (column before) and from its own CA. Vectors are arrays here: spelt out, the expression outgrows a method of generated code."""
    vector = lambda p: F.array(*(F.col(f"{p}.{c}") for c in "xyz"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: F.transform(v, lambda x: F.when(norm(v) > 0, x / norm(v)).otherwise(0.0))
    from_point = lambda p: unit(F.zip_with(vector("N"), vector(p), lambda x, y: x - y))
    h = F.zip_with(vector("N"), unit(F.zip_with(from_point("before"), from_point("CA"), lambda x, y: x + y)), lambda n, d: n + NH * d)
    return F.struct(*(F.get(h, F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def backbone(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain, k, size, N, CA, C, O): residues with all four atoms, counted from 0 in the order of their numbers, and how many their chain has.

    ``atoms`` has structure_id, chain, res_seq, atom_name, line_no, x, y, z, and optionally hetflag with what readers add. Of atoms with one name the first counts.
    """
    rows = standard_residues(atoms) if "hetflag" in atoms.columns else atoms
    by = ["structure_id", "chain", "res_seq", *(["icode"] if "icode" in atoms.columns else [])]
    found = [F.min_by(F.when(F.col("atom_name") == a, F.struct("x", "y", "z")), F.when(F.col("atom_name") == a, F.col("line_no"))).alias(a) for a in BACKBONE]
    whole = rows.where(F.col("atom_name").isin(*BACKBONE)).groupBy(*by).agg(*found).dropna(subset=list(BACKBONE))
    chain = Window.partitionBy("structure_id", "chain")
    k = F.row_number().over(chain.orderBy(*by[2:])) - 1
    return whole.select("structure_id", "chain", k.alias("k"), F.count("*").over(chain).alias("size"), *BACKBONE)


def hydrogen_bonds(residues: DataFrame) -> DataFrame:
    """(structure_id, chain, i, j, size): the C=O of residue i takes the N-H of residue j of its chain.

    Residues are those of :func:`backbone`. The hydrogen stands off N between the directions away from the C before it and from its own CA, so a chain's
    first residue gives none; its last one takes none. Neighbours (j - i from 0 to 2) have no bond. Pairs are formed between neighbouring cells only.
    """
    before = F.lag("C").over(Window.partitionBy("structure_id", "chain").orderBy("k"))
    rows = residues.withColumn("before", before).withColumn("H", _hydrogen())
    key = F.struct("structure_id", "chain").alias("structure_id")
    takers = rows.where("k < size - 1").select(key, "k", "size", "C", "O", *(F.col(f"O.{c}").alias(c) for c in "xyz"))
    givers = rows.where("k > 0").select(key, "k", "N", "H", *(F.col(f"N.{c}").alias(c) for c in "xyz"))
    pairs = near_pairs(takers, givers, REACH).where(~(F.col("r_k") - F.col("l_k")).between(0, 2))
    far = {"on": ("l_O", "r_N"), "ch": ("l_C", "r_H"), "oh": ("l_O", "r_H"), "cn": ("l_C", "r_N")}
    near = pairs.select("l_structure_id", "l_k", "r_k", "l_size", *(_length(_difference(*ends)).alias(name) for name, ends in far.items()))
    energy = COUPLING * (1 / F.col("on") + 1 / F.col("ch") - 1 / F.col("oh") - 1 / F.col("cn"))
    return near.where(energy < BOND_ENERGY).select("l_structure_id.structure_id", "l_structure_id.chain", F.col("l_k").alias("i"), F.col("r_k").alias("j"), F.col("l_size").alias("size"))


def secondary_structure(residues: DataFrame) -> DataFrame:
    """(structure_id, chain, k, state): helix, sheet or loop for each residue of :func:`backbone`.

    Two turns of a kind that begin at neighbours make a helix of three, four or five residues; four goes before the others. Two bonds that make a
    parallel or antiparallel bridge put both residues into a sheet; helix goes before sheet.
    """
    chain = ["structure_id", "chain"]
    # Each bond asks for the second bonds that make a bridge of two residues with it, and answers for itself: both meet under the bond's places.
    i, j, none = F.col("i"), F.col("j"), F.lit(None).cast("array<int>")
    wanted = [(j, i, i, j), (j - 2, i + 2, i + 1, j - 1), (j, i + 2, i + 1, j)]
    rows = [F.struct(a.alias("i"), b.alias("j"), F.array(c, d).alias("both")) for a, b, c, d in wanted] + [F.struct(i.alias("i"), j.alias("j"), none.alias("both"))]
    asked = hydrogen_bonds(residues).select(*chain, "size", F.explode(F.array(*rows)).alias("w")).groupBy(*chain, "w.i", "w.j").agg(F.max("size").alias("size"), F.collect_list("w.both").alias("bridged"), F.bool_or(F.col("w.both").isNull()).alias("bond"))
    inner = F.filter("bridged", lambda x: F.forall(x, lambda k: (k >= 1) & (k <= F.col("size") - 2)))
    mark = lambda k, **what: F.struct(k.alias("k"), *(what.get(c, F.lit(False)).alias(c) for c in ("t3", "t4", "t5", "ladder")))
    turn = mark(i, **{f"t{s}": j - i == s for s in (3, 4, 5)})
    marks = F.array_append(F.transform(F.array_distinct(F.flatten(inner)), lambda k: mark(k, ladder=F.lit(True))), turn)
    marked = asked.where("bond").select(*chain, F.explode(marks).alias("m")).groupBy(*chain, "m.k").agg(*(F.bool_or(f"m.{c}").alias(c) for c in ("t3", "t4", "t5", "ladder")))
    rows = residues.select(*chain, "k").join(marked, [*chain, "k"], "left")
    along = Window.partitionBy(*chain).orderBy("k")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reaches = lambda c, s: yes(F.max(c).over(along.rowsBetween(1 - s, 0)))
    for s in (3, 4, 5):
        rows = rows.withColumn(f"h{s}", yes(F.col(f"t{s}") & F.lag(f"t{s}").over(along)))
    rows = rows.withColumn("helix4", reaches("h4", 4))
    free = ~F.col("helix4") & ~yes(F.lead("helix4").over(along))
    rows = rows.withColumns({f"h{s}": F.col(f"h{s}") & free for s in (3, 5)})
    helix = F.col("helix4") | reaches("h3", 3) | reaches("h5", 5)
    return rows.select(*chain, "k", F.when(helix, "helix").when(F.col("ladder"), "sheet").otherwise("loop").alias("state"))


def secondary_fractions(atoms: DataFrame, chain: str | None = None) -> DataFrame:
    """(structure_id, chain, n_residues, helix_fraction, sheet_fraction, loop_fraction) of every chain, or of one. Chains without a whole residue have no row."""
    rows = atoms if chain is None else atoms.where(F.col("chain") == chain)
    share = lambda s: F.avg((F.col("state") == s).cast("double")).alias(f"{s}_fraction")
    return secondary_structure(backbone(rows)).groupBy("structure_id", "chain").agg(F.count("*").alias("n_residues"), *map(share, ("helix", "sheet", "loop")))
