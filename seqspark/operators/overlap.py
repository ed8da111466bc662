"""Superposition of models and the distances that remain, and the joining of score families."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = "xyz"


def aligned_offset(longer: Column, shorter: Column) -> Column:
    """Where one sequence stands within the other, from 0; null if it doesn't."""
    at = F.greatest(F.instr(longer, shorter), F.instr(shorter, longer))
    return F.when(at > 0, at - 1)


def rotations(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centroids (px.., qx..), rotation r00..r22 and n of the best superposition of p on q, from paired points.

    Sums of products are aggregated by Spark; a task then decomposes nine numbers for each group. Groups of fewer than three points have null rotations.
    """
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "pq" for c in AXES), *(F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"h{a}{b}") for a in AXES for b in AXES))
    numbers = [f"r{i}{j}" for i in range(3) for j in range(3)]
    schema = means.select(*keys, "n", *(f"m{s}{c}" for s in "pq" for c in AXES), *(F.lit(0.0).alias(r) for r in numbers)).schema
    for f in schema.fields:
        f.nullable = True

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, q = (b[[f"m{s}{c}" for c in AXES]].to_numpy(float) for s in "pq")
            h = b[[f"h{a}{c}" for a in AXES for c in AXES]].to_numpy(float).reshape(-1, 3, 3) - b["n"].to_numpy(float)[:, None, None] * p[:, :, None] * q[:, None, :]
            u, _, vt = np.linalg.svd(h)
            flip = np.tile(np.eye(3), (len(b), 1, 1))
            flip[:, 2, 2] = np.sign(np.linalg.det(u @ vt))
            r = np.swapaxes(u @ flip @ vt, 1, 2).reshape(-1, 9)
            r[b["n"].to_numpy() < 3] = np.nan
            out = b[[*keys, "n", *(f"m{s}{c}" for s in "pq" for c in AXES)]].copy()
            out[numbers] = r
            yield out

    solved = means.mapInPandas(solve, schema)
    return solved.withColumns({r: F.when(~F.isnan(r), F.col(r)) for r in numbers})


def superposed_rmsd(models: DataFrame, reference: DataFrame, receptor: str = "A", sequence: str = "B") -> DataFrame:
    """(structure_id, model, rmsd): models are laid on the reference by their receptor atoms; rmsd is over the sequence's atoms. Null where fewer than three atoms pair.

    Atoms are (structure_id, model, chain, res_idx, x, y, z); the reference has no model column. They pair by chain and residue.
    """
    point = lambda df, s: df.select(*[c for c in ("structure_id", "model", "chain", "res_idx") if c in df.columns], *(F.col(c).alias(f"{s}{c}") for c in AXES))
    pairs = point(models, "p").join(point(reference, "q"), ["structure_id", "chain", "res_idx"])
    turn = rotations(pairs.where(F.col("chain") == receptor), ["structure_id", "model"])
    rows = pairs.where(F.col("chain") == sequence).join(turn, ["structure_id", "model"])
    moved = [sum((F.col(f"r{i}{j}") * (F.col(f"p{c}") - F.col(f"mp{c}")) for j, c in enumerate(AXES)), F.col(f"mq{AXES[i]}")) for i in range(3)]
    square = sum(((m - F.col(f"q{c}")) ** 2 for m, c in zip(moved, AXES, strict=True)), F.lit(0.0))
    return rows.groupBy("structure_id", "model").agg(F.sqrt(F.avg(square)).alias("rmsd"))


def intra_model_rmsd(models: DataFrame, receptor: str = "A", sequence: str = "B") -> DataFrame:
    """(structure_id, n_models, mean_rmsd): all models are laid on the first, then the mean over pairs of models; null below two models."""
    first = models.groupBy("structure_id").agg(F.min("model").alias("model"))
    reference = models.join(first, ["structure_id", "model"], "left_semi").drop("model")
    point = lambda df, s: df.select(*[c for c in ("structure_id", "model", "chain", "res_idx") if c in df.columns], *(F.col(c).alias(f"{s}{c}") for c in AXES))
    pairs = point(models, "p").join(point(reference, "q"), ["structure_id", "chain", "res_idx"])
    turn = rotations(pairs.where(F.col("chain") == receptor), ["structure_id", "model"])
    rows = point(models.where(F.col("chain") == sequence), "p").join(turn, ["structure_id", "model"])
    moved = {c: sum((F.col(f"r{i}{j}") * (F.col(f"p{d}") - F.col(f"mp{d}")) for j, d in enumerate(AXES)), F.col(f"mq{c}")) for i, c in enumerate(AXES)}
    laid = rows.select("structure_id", "model", "res_idx", *(m.alias(c) for c, m in moved.items()))
    a, b = laid.alias("a"), laid.alias("b")
    on = (F.col("a.structure_id") == F.col("b.structure_id")) & (F.col("a.res_idx") == F.col("b.res_idx")) & (F.col("a.model") < F.col("b.model"))
    square = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in AXES), F.lit(0.0))
    per = a.join(b, on).groupBy(F.col("a.structure_id").alias("structure_id"), F.col("a.model").alias("m"), F.col("b.model").alias("n")).agg(F.sqrt(F.avg(square)).alias("d"))
    mean = per.groupBy("structure_id").agg(F.avg("d").alias("mean_rmsd"))
    return models.groupBy("structure_id").agg(F.count_distinct("model").alias("n_models")).join(mean, "structure_id", "left")


def inter_model_rmsd(one: DataFrame, other: DataFrame, receptor: str = "A", sequence: str = "B") -> DataFrame:
    """(structure_id, rmsd) of two methods' models, paired by structure: the first is laid on the second by the receptor."""
    return superposed_rmsd(one.withColumn("model", F.lit(0)), other.drop("model"), receptor, sequence).select("structure_id", "rmsd")


def batch_scores(scorers: dict, requested: list[str], key: str = "structure_id") -> DataFrame:
    """The requested families of scores of all inputs as one wide table; families that aren't requested are never planned. An unknown one is an error."""
    return assembled([scorers[n]() for n in required_scores(requested, list(scorers))], key)


def models_in_site(flags: DataFrame) -> DataFrame:
    """(structure_id, share, top, top_contacts, n_models) of (structure_id, model, in_site, n_in_site): share of models in the site, whether model 1 is, and its contacts if it is (else 0)."""
    first = F.col("model") == 1
    contacts = F.coalesce(F.max(F.when(first & F.col("in_site"), F.col("n_in_site"))), F.lit(0)).alias("top_contacts")
    return flags.groupBy("structure_id").agg(F.avg(F.col("in_site").cast("double")).alias("share"), F.max(F.when(first, F.col("in_site"))).alias("top"), contacts, F.count("*").alias("n_models"))


def assembled(families: list[DataFrame], key: str = "seq_id") -> DataFrame:
    """One wide row for each key, by one outer join a family."""
    out = families[0]
    for f in families[1:]:
        out = out.join(f, key, "full_outer")
    return out


def aliased(long: DataFrame, methods: list[str], names: list[str], key: str = "seq_id") -> DataFrame:
    """Scores by method as ``method_name`` columns; where only one method has a value, ``name`` is that value, 0 and false included."""
    out = long.groupBy(key).pivot("method", methods).agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))
    if len(names) == 1:
        out = out.select(key, *(F.col(m).alias(f"{m}_{names[0]}") for m in methods))
    for n in names:
        columns = [F.col(f"{m}_{n}") for m in methods]
        held = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
        out = out.withColumn(n, F.when(held == 1, F.coalesce(*columns)))
    return out


def same_sequences(results: DataFrame) -> DataFrame:
    """Sequences that some method lacks, with how many have it; empty where all agree."""
    n = results.select("method").distinct().count()
    return results.groupBy("sequence").agg(F.count_distinct("method").alias("methods")).where(F.col("methods") < n)


def available_scores(catalog: DataFrame, complexes: DataFrame) -> DataFrame:
    """(complex_id, scores) that can be computed: ``catalog`` has score and what it needs (needs_structure, needs_site, needs_template, needs_confidence), complexes have has_ columns. The catalog has a row for each kind of score."""
    return complexes.select("complex_id", _available(catalog).alias("scores"))


def _available(catalog: DataFrame, most: int = 1000) -> Column:
    """Sorted names of the scores whose needs a row meets. The catalog becomes a literal; a longer one than ``most`` is an error."""
    kinds = catalog.limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError(f"a catalog has at most {most} kinds of scores")
    needs = [c.removeprefix("needs_") for c in catalog.columns if c.startswith("needs_")]
    names = []
    for r in kinds:
        met = F.lit(True)
        for n in needs:
            met = met & F.col(f"has_{n}") if r[f"needs_{n}"] else met
        names.append(F.when(met, F.lit(r["score"])))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))) if names else F.array().cast("array<string>")


def unavailable_scores(catalog: DataFrame, complexes: DataFrame, requested: list[str]) -> DataFrame:
    """(complex_id, missing) of the complexes for which a requested score can't be computed, unknown names included."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, requested)), _available(catalog)))
    return complexes.select("complex_id", missing.alias("missing")).where(F.size("missing") > 0)


def with_templates(inputs: DataFrame, templates: DataFrame, key: str = "seq_id") -> DataFrame:
    """Each input with its template, null where there is none. ``templates`` has a row for each key."""
    return inputs.join(templates, key, "left")


def with_provenance(scores: DataFrame, peptides: DataFrame) -> DataFrame:
    """Scores of sequences with the first place (protein_id, start_pos) that the sequence was taken from."""
    return scores.join(first_places(peptides), "sequence", "left").select(*scores.columns, "protein_id", "start_pos")


def first_places(peptides: DataFrame) -> DataFrame:
    """(sequence, protein_id, start_pos): of each sequence's places the one with the least protein_id and then the least start_pos, nulls last.

    Where both are whole numbers (start_pos of 32 bits at most), a place is one number, so that places are aggregated by hashes; structs would have all peptides sorted before and after the shuffle.
    The number is a long for ids from -2^30 to 2^30 - 1 and a decimal for others and null.
    """
    types = {f.name: f.dataType for f in peptides.schema.fields}
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    if not (isinstance(types["protein_id"], (*narrow, T.LongType)) and isinstance(types["start_pos"], narrow)):
        key = F.struct(F.col("protein_id").isNull().alias("no_protein"), "protein_id", F.col("start_pos").isNull().alias("no_start"), "start_pos")
        return peptides.groupBy("sequence").agg(F.min(key).alias("at")).select("sequence", "at.protein_id", "at.start_pos")
    unit, most = 2**33, 2**30
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    protein = F.col("protein_id").cast("long")
    start = F.coalesce(F.col("start_pos").cast("long") + 2**31, F.lit(2**32))  # 0 to 2^32, null as the last
    fits = protein.between(-most, most - 1)
    near = F.min(F.when(fits, protein * unit + start))
    far = F.min(F.when(fits.isNull() | ~fits, F.coalesce(protein.cast("decimal(20,0)"), whole(2**63)) * whole(unit) + start.cast("decimal(20,0)")))
    first = peptides.groupBy("sequence").agg(near.alias("near"), far.alias("far"))
    least = F.least("far", F.col("near").cast(first.schema["far"].dataType))
    rest = F.pmod(least, whole(unit))
    id_of = F.when(F.col("far").isNull(), F.shiftright("near", 33)).otherwise(F.nullif((least - rest) / whole(unit), whole(2**63)).cast("long"))
    start_of = F.when(F.col("far").isNull(), F.col("near").bitwiseAND(F.lit(unit - 1))).otherwise(rest.cast("long"))
    return first.select("sequence", id_of.cast(types["protein_id"]).alias("protein_id"), (F.nullif(start_of, F.lit(2**32)) - 2**31).cast(types["start_pos"]).alias("start_pos"))


def required_scores(requested: list[str], available: list[str]) -> list[str]:
    """The requested names; an unknown or unavailable one is an error that names it."""
    if missing := sorted(set(requested) - set(available)):
        raise ValueError(f"can't be computed here: {', '.join(missing)}; there are {', '.join(sorted(available))}")
    return requested
