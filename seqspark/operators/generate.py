"""Candidate generation with key-deterministic randomness: the same seed and key give the same candidate on any partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.functions import properties
from seqspark.functions.exprs import ALPHABET, normal, uniform
from seqspark.functions.storage import folder, pinned
from seqspark.operators.order import first_rows, ranked


def uniform_int(seed: int, low: int | Column, high: int | Column, *key: Column | str) -> Column:
    """An integer from low to high, both included."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (lo + F.floor(uniform(seed, *key) * (hi - lo + 1))).cast("int")


def random_sequences(spark: SparkSession, n: int, shortest: int, longest: int, seed: int = 42) -> DataFrame:
    """(id, sequence): uniform lengths and letters."""
    length = uniform_int(seed, shortest, longest, "id", F.lit("length"))
    return letters(spark.range(n).withColumn("length", length), seed)


def letters(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(id, sequence) of ``rows`` (id, length) with uniform letters."""
    letter = lambda i: F.substr(F.lit(ALPHABET), uniform_int(seed, 1, len(ALPHABET), F.col("id"), i), F.lit(1))
    return rows.select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("length")), letter), "").alias("sequence"))


def poisson(mean: Column, u: Column) -> Column:
    """Inverse of the distribution function at ``u``, a uniform of 32 bits, for means of up to 500.

    The sum runs so far that no such uniform lies beyond it: the tail beyond is below 2^-33.
    """
    # The uniform is part of the state: within the lambda it would be worked out anew at each step.
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), F.when(s["u"] > s["c"], k).otherwise(s["n"]).alias("n"), s["u"].alias("u"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"), u.alias("u"))
    end = F.ceil(mean + 8 * F.sqrt(mean) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), end), start, step, lambda s: s["n"])


def _edits(mean: Column, u: Column, many: Column, usual: int = 5) -> Column:
    """max(1, the same number) for a stored uniform: compared with the first ``usual`` sums directly, and ``many`` where it lies beyond them."""
    p, c, known = F.exp(-mean), F.exp(-mean), []
    for k in range(1, usual + 1):
        p = p * mean / k
        c = c + p
        known.append((u <= c, k))
    out = F.when(*known[0])
    for condition, k in known[1:]:
        out = out.when(condition, k)
    return out.otherwise(F.greatest(F.lit(1), many))


def poisson_count(mean: Column, seed: int, *key: Column | str) -> Column:
    """A Poisson number of the key alone, for any mean: a sum over parts of 500 at most."""
    parts = F.greatest(F.lit(1), F.ceil(mean / 500)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson(mean / parts, uniform(seed, *key, i)))


def mutated(rows: DataFrame, rate: float = 0.05, shortest: int = 5, longest: int = 40, seed: int = 42, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """``key``, parent and sequence: max(1, Poisson(length * rate)) edits of each parent of ``rows`` (the key's columns, parent), drawn by the key.

    An edit substitutes a letter by another one (weight 1), deletes one or inserts one (0.1 each, where the length allows). The caller drops what is unchanged.
    """
    mean, size, unrolled = F.length("parent") * rate, len(ALPHABET), 3
    many = poisson_count(mean, seed, *key, F.lit("edits"))
    draws = lambda k: F.struct(*(uniform(seed, *key, k, F.lit(what)).alias(what) for what in ("op", "at", "aa")))

    def edit(s: Column, u: Column) -> Column:
        length = F.length(s)
        delete, insert = F.when(length > shortest, 0.1).otherwise(0.0), F.when(length < longest, 0.1).otherwise(0.0)
        choice = u["op"] * (1 + delete + insert)
        at = F.floor(u["at"] * length).cast("int")
        old = F.instr(F.lit(ALPHABET), F.substr(s, at + 1, F.lit(1)))
        pick = lambda i: F.substr(F.lit(ALPHABET), i.cast("int"), F.lit(1))
        other = pick((old + F.floor(u["aa"] * (size - 1))) % size + 1)
        head, tail = F.substr(s, F.lit(1), at), F.substr(s, at + 2, F.length(s))
        place = F.floor(u["at"] * (length + 1)).cast("int")
        inserted = F.concat(F.substr(s, F.lit(1), place), pick(F.floor(u["aa"] * size) + 1), F.substr(s, place + 1, F.length(s)))
        return F.when(choice < 1, F.concat(head, other, tail)).when(choice < 1 + delete, F.concat(head, tail)).otherwise(inserted)

    # Most parents have few edits: these are compiled, with draws that are columns, and only later ones go through a lambda.
    rows = rows.withColumn("_u", uniform(seed, *key, F.lit("edits"), F.lit(1)))
    rows = rows.withColumn("n", F.when(mean <= 500, _edits(mean, F.col("_u"), poisson(mean, F.col("_u")))).otherwise(F.greatest(F.lit(1), many))).withColumn("_s", F.col("parent"))
    for k in range(1, unrolled + 1):
        due = F.col("n") >= k
        rows = rows.withColumn("_d", F.when(due, draws(F.lit(k)))).withColumn("_s", F.when(due, edit(F.col("_s"), F.col("_d"))).otherwise(F.col("_s")))
    later = F.aggregate(F.sequence(F.lit(unrolled + 1), F.col("n")), F.col("_s"), lambda s, k: F.transform(F.array(draws(k)), lambda u: edit(s, u))[0])
    # Out of an array, so that a caller's filter isn't pushed down, which would put the whole expression in place of each mention of the sequence.
    return rows.select(*key, "parent", F.explode(F.array(F.when(F.col("n") > unrolled, later).otherwise(F.col("_s")))).alias("sequence"))


def _unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (stored, few beside ``known``) whose sequence isn't known. Known sequences are filtered by those of the rows as they are read, so a large table is neither shuffled nor made distinct."""
    met = known.select("sequence").join(F.broadcast(rows.select("sequence").distinct()), "sequence", "left_semi").distinct()
    return rows.join(met, "sequence", "left_anti")


def _children(proposals: DataFrame, known: DataFrame, tries: int, seed: int, **how) -> DataFrame:
    """(id, sequence): the first valid child of each proposal (id, parent): changed, within the lengths and not known. Proposals without one after ``tries`` attempts are left out.

    Attempts double from step to step and only go on for proposals that have no child yet, so steps are few and most proposals are mutated once.
    """
    shortest, longest = how.get("shortest", 5), how.get("longest", 40)
    found, left, done = None, proposals, 0
    while done < tries:
        more = min(max(1, done), tries - done)
        each = left.withColumn("attempt", F.explode(F.sequence(F.lit(done), F.lit(done + more - 1))))
        valid = mutated(each, seed=seed, key=("id", "attempt"), **how).where((F.col("sequence") != F.col("parent")) & F.length("sequence").between(shortest, longest))
        fresh = pinned(_unknown(pinned(valid), known).groupBy("id").agg(F.min_by("sequence", "attempt").alias("sequence")))
        found = fresh if found is None else found.unionByName(fresh)
        left, done = left.join(fresh.select("id"), "id", "left_anti"), done + more
        if left.isEmpty():
            break
    return found


def _first_distinct(propose, k: int, least: int = 64, given: tuple[int, DataFrame] | None = None) -> DataFrame | None:
    """The first k rows of distinct ``sequence`` by ``id`` out of ``propose(first, n)``, proposals first to first + n - 1.

    Rounds ask for twice what falls short, or as many as were proposed before if that is more, and for ``least`` at least, until k are found or max(20 k, 10 000) proposals are made.
    How many a round asks for doesn't change what is found. ``given``: a number n and what ``propose(0, n)`` gives, where that is known.
    """
    pool, made, have, most = None, 0, 0, max(20 * k, 10_000)
    while have < k and made < most:
        n = min(given[0] if given and not made else max(2 * (k - have), made, least), most - made)
        fresh = given[1].where(F.col("id") < n) if given and not made else propose(made, n)
        pool = fresh if pool is None else pool.unionByName(fresh)
        first = Window.partitionBy("sequence").orderBy("id")
        pool = pinned(pool.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
        made, have = made + n, pool.count()
    return first_rows(pool, k, ("id", True), ("sequence", True)) if pool is not None else None


def mutant_pool(parents: DataFrame, k: int, known: DataFrame, tries: int = 256, seed: int = 42, **how) -> DataFrame:
    """k distinct children (sequence) of random parents that are neither known nor equal to their parent.

    A proposal keeps its parent and is mutated again until its child is valid. Fewer than k come back only where max(20 k, 10 000) proposals with ``tries`` attempts each don't give as many.
    """
    spark = parents.sparkSession
    parents = pinned(parents.select("sequence").distinct())
    indexed = pinned(_dense_index(parents, "sequence").withColumnRenamed("sequence", "parent"))
    n = indexed.count()
    if not n or k <= 0:
        return parents.select("sequence").limit(0)

    def propose(first: int, count: int) -> DataFrame:
        ids = spark.range(first, first + count).withColumn("place", F.floor(uniform(seed, "id", F.lit("parent")) * n).cast("long"))
        return _children(pinned(ids.join(indexed, "place").select("id", "parent")), known, tries, seed, **how)

    return _first_distinct(propose, k).select("sequence")


def peptide_length(seed: int, low: int, high: int, *key: Column | str, gaussian: bool = False) -> Column:
    """Uniform, or normal around the middle with a sixth of the range as deviation, towards zero and within bounds."""
    if not gaussian:
        return uniform_int(seed, low, high, *key)
    draw = F.lit((low + high) / 2) + F.lit((high - low) / 6) * normal(seed, *key)
    return F.greatest(F.lit(low), F.least(F.lit(high), draw.cast("int")))


#: So many windows of one round are sent to the proteins; more are joined by shuffles.
FEW = 1_000_000
#: A round of peptides reads the proteins once, whatever it asks for, so it asks for many.
_AT_ONCE = 1024


def sampled_peptides(proteins: DataFrame, n: int, low: int, high: int, seed: int = 42, gaussian: bool = False) -> DataFrame:
    """(id, protein_id, start_pos, sequence): n proposals, each from a random protein at a random midpoint; a protein that is too short is taken whole."""
    return _sampled(protein_index(proteins), proteins, 0, n, low, high, seed, gaussian)


def protein_index(proteins: DataFrame) -> DataFrame:
    """(place, protein_id, letters_in_all) of the proteins that aren't empty, in the order of their ids, stored. Of a sequence only its length is kept."""
    lengths = pinned(proteins.select("protein_id", F.length("sequence").alias("letters_in_all")))
    return pinned(_dense_index(lengths.where("letters_in_all > 0"), "protein_id"))


def _sampled(indexed: DataFrame, proteins: DataFrame, first: int, n: int, low: int, high: int, seed: int, gaussian: bool) -> DataFrame:
    """Proposals first to first + n - 1 from ``proteins`` with their index."""
    count = indexed.count()
    ids = indexed.sparkSession.range(first, first + n).withColumn("place", F.floor(uniform(seed, "id", F.lit("protein")) * count).cast("long"))
    few = n <= FEW
    rows = indexed.join(F.broadcast(ids) if few else ids, "place").withColumn("size", peptide_length(seed, low, high, "id", F.lit("length"), gaussian=gaussian))
    whole = F.col("letters_in_all")
    middle = F.floor(uniform(seed, "id", F.lit("middle")) * whole).cast("int")
    start = F.when(whole <= F.col("size"), 0).otherwise(F.greatest(F.lit(0), F.least(whole - F.col("size"), middle - F.floor(F.col("size") / 2).cast("int"))))
    rows = rows.select("id", "protein_id", start.alias("start_pos"), "size")
    return windows(rows, proteins, high, few=few).select("id", "protein_id", "start_pos", "sequence")


def _dense_index(df: DataFrame, *key: str) -> DataFrame:
    """Rows with ``place`` from 0 in the order of the key: ranks within ranges plus the sizes of earlier ranges, so no task orders all rows."""
    return ranked(df, folder(df.sparkSession, "ranges"), *((k, True) for k in key)).withColumn("place", F.col("rank").cast("long") - 1).drop("rank")


def local_peptides(scored: DataFrame, proteins: DataFrame, per_parent: int, position_spread: float, length_spread: float, low: int, high: int, seed: int = 42) -> DataFrame:
    """(id, protein_id, start_pos, sequence): shifted and resized copies of ``scored`` peptides (protein_id, start_pos, sequence), within their proteins. A scored peptide begins within its protein.

    One join: a normal number of :func:`normal` is below 6.77, so a copy lies within reach of its parent, and a parent meets the piece of its protein that covers all of its copies. Copies are made after that, and no sequence of a parent travels.
    """
    reach = max(high, math.ceil(6.77 * position_spread) + 1)
    wide, chunk = 2 * reach + high + 1, 512
    parents = scored.select("protein_id", F.col("start_pos").alias("at"), F.length("sequence").alias("size"), F.floor(F.greatest(F.lit(0), F.col("start_pos") - reach) / chunk).cast("int").alias("chunk"))
    pieces = F.regexp_extract_all("sequence", F.lit(rf"(?=(.{{1,{chunk + wide - 1}}})).{{1,{chunk}}}"), F.lit(1))
    pieces = proteins.select("protein_id", F.length("sequence").alias("letters_in_all"), F.posexplode(pieces).alias("chunk", "letters"))
    rows = parents.join(pieces, ["protein_id", "chunk"]).withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(per_parent - 1))))
    key = ("protein_id", "at", "id")
    size = F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.col("size") + length_spread * normal(seed, *key, F.lit("l"))).cast("int")))
    start = F.round(F.col("at") + position_spread * normal(seed, *key, F.lit("p"))).cast("int")
    rows = rows.withColumn("size", size).withColumn("start_pos", F.greatest(F.lit(0), F.least(F.col("letters_in_all") - F.col("size"), start)))
    return rows.select("id", "protein_id", "start_pos", F.substr("letters", F.col("start_pos") - chunk * F.col("chunk") + 1, F.col("size")).alias("sequence"))


def _local(copies: DataFrame, proteins: DataFrame, position_spread: float, length_spread: float, low: int, high: int, seed: int, few: bool = False) -> DataFrame:
    """Copies come with their protein's ``letters_in_all`` or get it here; ``few`` as for :func:`windows`."""
    if "letters_in_all" not in copies.columns:
        copies = copies.join(proteins.select("protein_id", F.length("sequence").alias("letters_in_all")), "protein_id")
    rows = copies.select("id", "protein_id", F.col("start_pos").alias("at"), F.length("sequence").alias("size"), "letters_in_all")
    key = ("protein_id", "at", "id")
    size = F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.col("size") + length_spread * normal(seed, *key, F.lit("l"))).cast("int")))
    rows = rows.withColumn("size", size)
    start = F.round(F.col("at") + position_spread * normal(seed, *key, F.lit("p"))).cast("int")
    rows = rows.select("id", "protein_id", F.greatest(F.lit(0), F.least(F.col("letters_in_all") - F.col("size"), start)).alias("start_pos"), "size")
    return windows(rows, proteins, high, few=few).select("id", "protein_id", "start_pos", "sequence")


def chunked(proteins: DataFrame, longest: int, chunk: int = 512) -> DataFrame:
    """(protein_id, chunk, letters): each sequence in pieces of ``chunk`` letters that overlap by ``longest`` - 1, cut in one pass, so that any window of up to ``longest`` letters lies within the piece of its start."""
    pieces = F.regexp_extract_all("sequence", F.lit(rf"(?=(.{{1,{chunk + longest - 1}}})).{{1,{chunk}}}"), F.lit(1))
    return proteins.select("protein_id", F.posexplode(pieces).alias("chunk", "letters"))  # none of an empty one


def windows(rows: DataFrame, proteins: DataFrame, longest: int, chunk: int = 512, few: bool = False) -> DataFrame:
    """``rows`` (protein_id, start_pos, size and others) with their ``sequence``. Only the piece that a window lies in travels with it, never the whole protein, so the work is linear in the number of windows whatever the proteins' lengths.

    With ``few`` (up to FEW rows) the windows go to the proteins: one reading, of which only proteins with a window are cut and nothing is shuffled."""
    at = rows.withColumn("chunk", F.floor(F.col("start_pos") / chunk).cast("int"))
    if few:
        proteins, at = proteins.join(F.broadcast(rows.select("protein_id").distinct()), "protein_id", "left_semi"), F.broadcast(at)
    joined = chunked(proteins, longest, chunk).join(at, ["protein_id", "chunk"])
    return joined.withColumn("sequence", F.substr("letters", F.col("start_pos") - chunk * F.col("chunk") + 1, F.col("size"))).drop("chunk", "letters")


def tiles(proteins: DataFrame, length: int, chunk: int = 512) -> DataFrame:
    """(protein_id, start_pos, sequence) of every window of ``length`` letters, out of overlapping pieces, so the work is linear in a sequence's length."""
    rows = chunked(proteins.where(F.length("sequence") >= length), length, chunk)
    last = F.least(F.lit(chunk), F.length("letters") - length + 1)
    cut = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct((F.col("chunk") * chunk + i).alias("start_pos"), F.substr(F.col("letters"), i + 1, F.lit(length)).alias("sequence")))
    return rows.where(last > 0).select("protein_id", F.explode(cut).alias("w")).select("protein_id", "w.start_pos", "w.sequence")


def tile_kinds(proteins: DataFrame, length: int) -> DataFrame:
    """(protein_id, n, kinds): how many windows of ``length`` letters a protein has, and how many different ones; those without a window are left out.

    Rows of a protein come together and are counted where they are cut: only sequences are shuffled, never a row for each window. Windows of letters A to Z are numbers of five bits a letter.
    """
    if length > 12:
        return tiles(proteins, length).groupBy("protein_id").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("kinds"))
    rows = proteins.select("protein_id", "sequence").where(F.length("sequence") >= length).repartition("protein_id").sortWithinPartitions("protein_id")
    schema = T.StructType([rows.schema["protein_id"], T.StructField("n", T.LongType()), T.StructField("kinds", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, numbers, texts, started = None, 0, np.zeros(0, np.int64), set(), False
        for batch in batches:
            ids, sequences, done = batch.column("protein_id").to_pylist(), batch.column("sequence"), []
            code, at = properties._letters(sequences)
            for k, i in enumerate(ids):
                if started and i != own:
                    done.append((own, n, len(numbers) + len(texts)))
                    n, numbers, texts = 0, np.zeros(0, np.int64), set()
                own, started = i, True
                letters = code[at[k] : at[k + 1]].astype(np.int64)
                m = len(letters) - length + 1
                n += m
                packed = np.zeros(m, np.int64)
                for j in range(length):
                    packed = packed * 32 + letters[j : j + m]
                if letters.max() > 25:  # windows with other letters are compared as text
                    other = np.convolve(letters > 25, np.ones(length, np.int64), "valid") > 0
                    s, packed = sequences[k].as_py(), packed[~other]
                    texts.update(s[p : p + length] for p in np.flatnonzero(other))
                fresh = np.unique(packed)
                numbers = np.union1d(numbers, fresh) if len(numbers) else fresh
            if done:
                yield _counted_batch(done, batch.schema)
                done = []
        if started:
            yield _counted_batch([(own, n, len(numbers) + len(texts))], batch.schema)

    return rows.mapInArrow(count, schema)


def _counted_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    ids, n, kinds = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, schema.field("protein_id").type), pa.array(n, pa.int64()), pa.array(kinds, pa.int64())], ["protein_id", "n", "kinds"])


_PEPTIDE = ["protein_id", "start_pos", "sequence"]


def _from_anywhere(proteins: DataFrame, indexed: DataFrame, low: int, high: int, seed: int, gaussian: bool = False):
    """A function of (first, n): those of the proposals first to first + n - 1 that pass the quality filter, stored."""
    from seqspark.operators.filters import quality_filter

    return lambda first, n: pinned(quality_filter(_sampled(indexed, proteins, first, n, low, high, seed, gaussian), longer_than=low - 1, shorter_than=high + 1).select("id", *_PEPTIDE))


def _from_near(scored: DataFrame, proteins: DataFrame, indexed: DataFrame, low: int, high: int, position_spread: float, length_spread: float, seed: int):
    """The same for copies of the ``scored`` peptides, which go round them by their place, so each has as many; None without any."""
    from seqspark.operators.filters import quality_filter

    parents = pinned(_dense_index(pinned(scored.select(*_PEPTIDE)), "sequence", "protein_id", "start_pos"))
    n_parents = parents.count()
    if not n_parents:
        return None
    parents = pinned(indexed.select("protein_id", "letters_in_all").join(F.broadcast(parents) if n_parents <= FEW else parents, "protein_id"))

    def draw(first: int, n: int) -> DataFrame:
        turns = parents.sparkSession.range(first, first + n).withColumn("place", F.col("id") % n_parents)
        near = _local(turns.join(parents, "place"), proteins, position_spread, length_spread, low, high, seed, n <= FEW)
        return pinned(quality_filter(near, longer_than=low - 1, shorter_than=high + 1).select("id", *_PEPTIDE))

    return draw


def _of_lengths(known: DataFrame, low: int, high: int) -> DataFrame:
    """The known sequences that a proposal can equal."""
    return known.select("sequence").where(F.length("sequence").between(low, high))


def global_peptides(proteins: DataFrame, k: int, known: DataFrame, low: int, high: int, seed: int = 42, gaussian: bool = False, indexed: DataFrame | None = None) -> DataFrame:
    """k distinct peptides (protein_id, start_pos, sequence) from anywhere in the proteins that pass the quality filter and aren't known; fewer only where max(20 k, 10 000) proposals don't give as many.

    ``indexed``: the proteins' :func:`protein_index`, for callers that sample more than once."""
    if k <= 0:
        return proteins.select("protein_id", F.lit(0).alias("start_pos"), "sequence").limit(0)
    draw, seen = _from_anywhere(proteins, protein_index(proteins) if indexed is None else indexed, low, high, seed, gaussian), _of_lengths(known, low, high)
    return _first_distinct(lambda first, n: _unknown(draw(first, n), seen), k, _AT_ONCE).select(*_PEPTIDE)


def near_peptides(scored: DataFrame, proteins: DataFrame, k: int, known: DataFrame, low: int, high: int, position_spread: float = 5.0, length_spread: float = 2.0, seed: int = 42, indexed: DataFrame | None = None) -> DataFrame:
    """k distinct peptides near the ``scored`` ones (protein_id, start_pos, sequence) that pass the quality filter and aren't known; fewer only where max(20 k, 10 000) proposals don't give as many.

    ``indexed`` as for :func:`global_peptides`."""
    draw = _from_near(scored, proteins, protein_index(proteins) if indexed is None else indexed, low, high, position_spread, length_spread, seed) if k > 0 else None
    if draw is None:
        return scored.select(*_PEPTIDE).limit(0)
    seen = _of_lengths(known, low, high)
    return _first_distinct(lambda first, n: _unknown(draw(first, n), seen), k, _AT_ONCE).select(*_PEPTIDE)


def mixed_peptides(scored: DataFrame, proteins: DataFrame, k: int, local: float, known: DataFrame, low: int, high: int, seed: int = 42, indexed: DataFrame | None = None) -> DataFrame:
    """k peptides with their origin: a share ``local`` from around the scored ones, the rest (and what falls short) from anywhere; distinct over both.

    The first proposals of both are held against the known ones together, which are read once unless these are too few."""
    indexed, n_near = protein_index(proteins) if indexed is None else indexed, int(k * local)
    near_draw = _from_near(scored, proteins, indexed, low, high, 5.0, 2.0, seed) if n_near > 0 else None
    if near_draw is None:
        return global_peptides(proteins, k, known, low, high, seed=seed + 1000 if n_near else seed, indexed=indexed).withColumn("origin", F.lit("global"))
    draw, seen = _from_anywhere(proteins, indexed, low, high, seed + 1000), _of_lengths(known, low, high)
    first = {"local": max(2 * n_near, _AT_ONCE), "global": max(2 * k, _AT_ONCE)}
    drawn = near_draw(0, first["local"]).withColumn("origin", F.lit("local")).unionByName(draw(0, first["global"]).withColumn("origin", F.lit("global")))
    fresh = pinned(_unknown(drawn, seen))
    given = lambda origin: fresh.where(F.col("origin") == origin).select("id", *_PEPTIDE)
    near = pinned(_first_distinct(lambda at, n: _unknown(near_draw(at, n), seen), n_near, _AT_ONCE, (first["local"], given("local"))).select(*_PEPTIDE))
    short, out = k - near.count(), near.withColumn("origin", F.lit("local"))
    if short <= 0:
        return out
    both = seen.unionByName(near.select("sequence"))
    rest = _first_distinct(lambda at, n: _unknown(draw(at, n), both), short, _AT_ONCE, (first["global"], _unknown(given("global"), near)))
    return out.unionByName(rest.select(*_PEPTIDE).withColumn("origin", F.lit("global")))


def _grown(start: DataFrame, n: int, seed: int, **how) -> DataFrame:
    """``start`` filled up to n by mutants of what is there, new ones included: each round the population at most doubles, so that later parents are mutants too."""
    out, have, turn = start, start.count(), 0
    while have < n:
        fresh = pinned(mutant_pool(out, min(have, n - have), out, seed=seed + turn, **how))
        out, found, turn = pinned(out.unionByName(fresh)), fresh.count(), turn + 1
        if not found:
            break
        have += found
    return out


def initial_population(given: DataFrame, n: int, least: int = 0, seed: int = 42, **how) -> DataFrame:
    """(sequence) to begin with: distinct ``given`` ones, filled up to n by their mutants; whole where they are n or more. Fewer than ``least`` in the end are an error."""
    start = pinned(given.select("sequence").distinct())  # every round reads it
    have = start.count()
    if not have:
        raise ValueError("an initial population needs one sequence at least")
    out = start if have >= n else _grown(start, n, seed, **how)
    if least and (found := out.count()) < least:
        raise ValueError(f"the initial population has {found} sequences, {least} are needed")
    return out


