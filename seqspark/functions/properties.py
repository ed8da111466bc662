"""Physico-chemical properties of sequences as columns. Letters outside the alphabet count as nothing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.exprs import ALPHABET, count_letter, count_letters

# Average masses of the amino acids and of water; Kyte and Doolittle (1982) hydropathy; Bjellqvist (1993) pK values; letter sets.
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERMINUS, PK_C_TERMINUS = 7.5, 3.55
PK_N_TERMINI = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_TERMINI = {"D": 4.55, "E": 4.75}
HELIX, TURN, SHEET = "EMALK", "NPGSD", "VIYFWLT"
HYDROPHOBIC, POLAR, POSITIVE, NEGATIVE, AROMATIC = "AVILMFWY", "NCQST", "KRH", "DE", "FWY"
PH_RANGE, PH_STEPS = (4.05, 12.0), 20


def length(s: Column) -> Column:
    return F.length(s).cast("long")


def molecular_weight(s: Column) -> Column:
    return sum((count_letter(s, a) * m for a, m in MASS.items()), F.lit(0.0)) - (F.length(s) - 1) * WATER


def fraction(s: Column, letters: str) -> Column:
    """Share of the sequence that is of these letters; null for an empty one."""
    return F.try_divide(count_letters(s, letters).cast("double"), F.length(s).cast("double"))


def gravy(s: Column) -> Column:
    return F.try_divide(sum((count_letter(s, a) * h for a, h in HYDROPATHY.items()), F.lit(0.0)), F.length(s).cast("double"))


def net_charge_fraction(s: Column) -> Column:
    return fraction(s, POSITIVE) - fraction(s, NEGATIVE)


def _charges(s: Column) -> dict[str, Column]:
    """Counts of the charged letters, and 10^pK of both ends."""
    of_end = lambda pk, at, usual: F.coalesce(*(F.when(at == a, 10.0**k) for a, k in pk.items()), F.lit(10.0**usual))
    counts = {a: count_letter(s, a).cast("double") for a in [*PK_POSITIVE, *PK_NEGATIVE]}
    return counts | {"first": of_end(PK_N_TERMINI, F.substring(s, 1, 1), PK_N_TERMINUS), "last": of_end(PK_C_TERMINI, F.substring(s, -1, 1), PK_C_TERMINUS)}


def _positive(t: Column, n) -> Column:
    """Whether the net charge is above zero where t = 10^pH; every group's share is a division. ``n`` gives the charges by name."""
    plus = n["first"] / (n["first"] + t) + sum((n[a] * (10.0**pk) / (10.0**pk + t) for a, pk in PK_POSITIVE.items()), F.lit(0.0))
    minus = t / (n["last"] + t) + sum((n[a] * t / (10.0**pk + t) for a, pk in PK_NEGATIVE.items()), F.lit(0.0))
    return plus > minus


def isoelectric_point(s: Column) -> Column:
    """pH of net charge zero, by a fixed number of bisections of PH_RANGE, as one column. For whole tables :func:`with_isoelectric_point` is faster."""

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        up = F.transform(F.array(F.pow(F.lit(10.0), mid)), lambda t: _positive(t, state["n"]))[0]
        return F.struct(F.when(up, mid).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(mid).alias("hi"), state["n"].alias("n"))

    counts = F.struct(*(c.alias(a) for a, c in _charges(s).items()))
    start = F.struct(F.lit(PH_RANGE[0]).alias("lo"), F.lit(PH_RANGE[1]).alias("hi"), counts.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PH_STEPS)), start, halve, lambda x: (x["lo"] + x["hi"]) / 2)


def with_isoelectric_point(df: DataFrame, s: Column, name: str = "isoelectric_point") -> DataFrame:
    """``df`` with the same number: each bisection is a projection of its own, so all of them are compiled and none is a lambda."""
    own, charge = df.columns, {a: F.col(f"_q_{a}") for a in [*PK_POSITIVE, *PK_NEGATIVE, "first", "last"]}
    rows = df.select("*", *(c.alias(f"_q_{a}") for a, c in _charges(s).items()), F.lit(PH_RANGE[0]).alias("_lo"), F.lit(PH_RANGE[1]).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    mid = (lo + hi) / 2
    for _ in range(PH_STEPS):
        up = _positive(F.pow(F.lit(10.0), mid), charge)
        rows = rows.select(*own, *charge.values(), F.when(up, mid).otherwise(lo).alias("_lo"), F.when(up, hi).otherwise(mid).alias("_hi"))
    return rows.select(*own, mid.alias(name))


#: So many letters of a batch are worked on at once, whatever the lengths of its sequences.
PIECE = 1 << 20
_OTHER = 26


def _letters(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of sequences (null: empty) the letters as 0 to 25, others as 26, and where each sequence begins, with the end. A letter is a code point."""
    a = a.fill_null("").cast(pa.large_string())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if len(data) and data.max() > 127:
        head = (data & 0xC0) != 0x80
        at, data = np.concatenate([[0], np.cumsum(head)])[at], data[head]
    code = data - np.uint8(65)
    return np.where(code < 26, code, np.uint8(_OTHER)), at


def _pieces(code: np.ndarray, at: np.ndarray):
    """(row, place in its sequence, letter, next letter or 26 at the end) of all letters, piece by piece."""
    for lo in range(0, len(code), PIECE):
        hi = min(lo + PIECE, len(code))
        first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
        row = np.repeat(np.arange(first, last), np.diff(np.clip(at[first : last + 1], lo, hi)))
        here = np.arange(lo, hi)
        following = np.append(code[lo + 1 : hi + 1], np.uint8(_OTHER))[: hi - lo]
        yield row, here - at[row], code[lo:hi], np.where(here + 1 < at[row + 1], following, np.uint8(_OTHER))


def letter_counts(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each sequence, a column for each letter and one for all others."""
    count = np.zeros((len(at) - 1, 27))
    for row, _, letter, _ in _pieces(code, at):
        count[row[0] : row[-1] + 1] += np.bincount((row - row[0]) * 27 + letter, minlength=27 * (row[-1] - row[0] + 1)).reshape(-1, 27)
    return count


def _table(values: dict[str, float]) -> np.ndarray:
    return np.array([float(values.get(chr(65 + i), 0.0)) for i in range(26)] + [0.0])


def _moments(code: np.ndarray, at: np.ndarray, degrees: float) -> np.ndarray:
    n, size, step = len(at) - 1, _table(HYDROPATHY), degrees * math.pi / 180
    x, y, a = np.zeros(n), np.zeros(n), np.zeros(n)
    for row, place, letter, _ in _pieces(code, at):
        h, angle, low = size[letter], place * step, row[0]
        for total, w in ((x, h * np.cos(angle)), (y, h * np.sin(angle)), (a, np.abs(h))):
            total[low : row[-1] + 1] += np.bincount(row - low, w)
    return np.where(a > 0, np.sqrt(x * x + y * y) / np.where(a > 0, a, 1), 0.0)


def _instabilities(code: np.ndarray, at: np.ndarray, weights: dict[str, float]) -> pa.Array:
    n, length, table = len(at) - 1, np.diff(at), np.zeros(27 * 27)
    for pair, w in weights.items():
        table[(ord(pair[0]) - 65) * 27 + ord(pair[1]) - 65] = w
    total = np.zeros(n)
    for row, _, letter, following in _pieces(code, at):
        total[row[0] : row[-1] + 1] += np.bincount(row - row[0], table[letter.astype(np.int64) * 27 + following])
    return pa.array(10 * total / np.maximum(length, 1), mask=length == 0)


def _isoelectric_points(count: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By the bisections of :func:`isoelectric_point`; ``count`` has a column for each letter."""

    def of_end(pk: dict[str, float], usual: float, place: np.ndarray) -> np.ndarray:
        table = np.array([10.0 ** pk.get(chr(65 + i), usual) for i in range(27)])
        return table[np.where(np.diff(at) > 0, np.append(code, np.uint8(_OTHER))[place], _OTHER)]

    first, last = of_end(PK_N_TERMINI, PK_N_TERMINUS, at[:-1]), of_end(PK_C_TERMINI, PK_C_TERMINUS, np.maximum(at[1:] - 1, 0))
    lo, hi = np.full(len(at) - 1, PH_RANGE[0]), np.full(len(at) - 1, PH_RANGE[1])
    for _ in range(PH_STEPS):
        mid = (lo + hi) / 2
        t = np.power(10.0, mid)
        plus = first / (first + t) + sum(count[:, ord(a) - 65] * (10.0**pk) / (10.0**pk + t) for a, pk in PK_POSITIVE.items())
        minus = t / (last + t) + sum(count[:, ord(a) - 65] * t / (10.0**pk + t) for a, pk in PK_NEGATIVE.items())
        lo, hi = np.where(plus > minus, mid, lo), np.where(plus > minus, hi, mid)
    return (lo + hi) / 2


def hydrophobic_moment(s: Column, degrees: float = 100.0) -> Column:
    """Length of the sum of hydropathies as vectors that turn by ``degrees`` at each residue, over the sum of their sizes; 0 if that is 0. Worked out for a batch of letters at once."""
    return F.arrow_udf(lambda a: pa.array(_moments(*_letters(a), degrees)), "double")(s)


def instability(s: Column, weights: dict[str, float]) -> Column:
    """10 / length times the sum of the weights of the sequence's pairs of letters; a pair without weight counts as 0. Null for an empty sequence."""
    return F.arrow_udf(lambda a: _instabilities(*_letters(a), weights), "double")(s)


_SETS = {"aromaticity": AROMATIC, "helix_fraction": HELIX, "turn_fraction": TURN, "sheet_fraction": SHEET, "hydrophobic_fraction": HYDROPHOBIC, "polar_fraction": POLAR, "positive_fraction": POSITIVE, "negative_fraction": NEGATIVE}
_WIDE = ("length", "molecular_weight", "aromaticity", "gravy", "helix_fraction", "turn_fraction", "sheet_fraction", "hydrophobic_fraction", "polar_fraction", "positive_fraction", "negative_fraction", "net_charge_fraction", "hydrophobic_moment", "instability", "isoelectric_point")


def with_all_properties(df: DataFrame, s: str, weights: dict[str, float]) -> DataFrame:
    """``df`` with all properties of its column ``s``, null for a null or empty sequence where the single columns are (and the isoelectric point of a null one): letters of a batch are counted once for all of them."""

    def numbers(a: pa.Array) -> pa.Array:
        code, at = _letters(a)
        length, null = np.diff(at), a.is_null().to_numpy(zero_copy_only=False)
        count = letter_counts(code, at)
        some = np.maximum(length, 1)
        share = {k: count @ _table(dict.fromkeys(v, 1.0)) / some for k, v in _SETS.items()}
        out = {"length": pa.array(length, pa.int64(), mask=null), "molecular_weight": pa.array(count @ _table(MASS) - (length - 1) * WATER, mask=null)}
        out |= {k: pa.array(v, mask=length == 0) for k, v in share.items()}
        out |= {"gravy": pa.array(count @ _table(HYDROPATHY) / some, mask=length == 0), "net_charge_fraction": pa.array(share["positive_fraction"] - share["negative_fraction"], mask=length == 0)}
        out |= {"hydrophobic_moment": pa.array(_moments(code, at, 100.0)), "instability": _instabilities(code, at, weights), "isoelectric_point": pa.array(_isoelectric_points(count, code, at), mask=null)}
        return pa.StructArray.from_arrays([out[c] for c in _WIDE], list(_WIDE))

    kind = ", ".join(f"{c} {'long' if c == 'length' else 'double'}" for c in _WIDE)
    return df.withColumn("_all", F.arrow_udf(numbers, f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")(F.col(s))).select(*df.columns, *(F.col(f"_all.{c}") for c in _WIDE))


def pair_weights(weights: DataFrame) -> dict[str, float]:
    """(pair, weight) as a mapping: of each pair of letters A to Z the largest weight, so there are at most 676."""
    rows = weights.where(F.col("pair").rlike("^[A-Z]{2}$")).groupBy("pair").agg(F.max("weight").alias("weight")).collect()
    return {r["pair"]: r["weight"] for r in rows}


def instability_index(sequences: DataFrame, weights: DataFrame, key: str = "sequence") -> DataFrame:
    """key and instability. ``weights`` (pair, weight) becomes a literal of at most 676 numbers, so nothing is joined."""
    return sequences.select(key).distinct().select(key, instability(F.col(key), pair_weights(weights)).alias("instability"))


def all_properties(s: Column, helix: str = HELIX, turn: str = TURN, sheet: str = SHEET) -> list[Column]:
    """One wide row, but for the isoelectric point, which :func:`with_isoelectric_point` adds, and the instability index, which needs a table of weights."""
    named = {
        "length": length(s), "molecular_weight": molecular_weight(s), "aromaticity": fraction(s, AROMATIC), "gravy": gravy(s),
        "helix_fraction": fraction(s, helix), "turn_fraction": fraction(s, turn), "sheet_fraction": fraction(s, sheet), "hydrophobic_fraction": fraction(s, HYDROPHOBIC), "polar_fraction": fraction(s, POLAR),
        "positive_fraction": fraction(s, POSITIVE), "negative_fraction": fraction(s, NEGATIVE), "net_charge_fraction": net_charge_fraction(s), "hydrophobic_moment": hydrophobic_moment(s),
    }
    return [c.alias(n) for n, c in named.items()]


__all__ = ["ALPHABET", "all_properties", "fraction", "gravy", "hydrophobic_moment", "instability_index", "isoelectric_point", "length", "molecular_weight", "net_charge_fraction", "with_isoelectric_point"]
