"""Fill-in-the-middle: a wavelet matrix over character classes counts the units before any place, and bisection on those ranks finds both cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import small_batches

#: Classes of characters; every class but the first begins a unit.
INSIDE, FIRST_LETTER, SPACE, OTHER = range(4)
#: Bytes of text that share a wavelet matrix; a longer text has one to itself.
BLOCK = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Bits:
    """A bit vector with a directory of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Bit planes of a sequence of classes, highest first; each plane is in the order that the planes above it sort the sequence into, zeros before ones."""

    def __init__(self, classes: np.ndarray, levels: int):
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(levels - 1, -1, -1):
            ones = (classes >> shift & 1).astype(bool)
            self.levels.append((Bits(ones), len(ones) - int(ones.sum())))
            classes = np.concatenate((classes[~ones], classes[ones]))

    def rank(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How many of a class stand before each place."""
        lo, hi = np.zeros_like(at), at
        for k, (bits, zeros) in enumerate(self.levels):
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = (zeros + a, zeros + b) if kind >> (len(self.levels) - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        """How many units begin before each place."""
        return self.rank(FIRST_LETTER, at) + self.rank(SPACE, at) + self.rank(OTHER, at)


def classes_of(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point of UTF-8 bytes that hold several texts, and how many code points stand before each of ``begin``."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    at = np.searchsorted(lead, begin)
    letter = _LETTER[first]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[at[at < len(lead)]] = False
    kind = np.where(letter, FIRST_LETTER, np.where(_SPACE[first], SPACE, OTHER)).astype(np.uint8)
    kind[inside] = INSIDE
    return kind, at


def cut_places(data: np.ndarray, begin: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and for each row of ``draws`` (one draw a text) the code points before the cut that lies ``draw mod (units + 1)`` units into the text.

    ``begin`` has one entry more than there are texts.
    """
    kind, at = classes_of(data, begin)
    matrix = WaveletMatrix(kind, 2)
    units = matrix.boundaries(at)
    n = np.diff(units)
    wanted = draws % (n + 1)
    # The least place with so many boundaries before it and one at it; a text's end where all its units are wanted.
    lo, hi = (np.broadcast_to(x, draws.shape).ravel().copy() for x in (at[:-1], at[1:]))
    goal = (units[:-1] + wanted).ravel()
    left = np.flatnonzero(lo < hi)
    while len(left):
        middle = (lo[left] + hi[left]) // 2
        enough = matrix.boundaries(middle + 1) > goal[left]
        hi[left[enough]] = middle[enough]
        lo[left[~enough]] = middle[~enough] + 1
        left = left[lo[left] < hi[left]]
    return n, lo.reshape(draws.shape) - at[:-1]


def _cut_texts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    draws = np.array([one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)], np.int64)
    raw = texts.cast(pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    n, cuts = np.zeros(len(raw), np.int64), np.zeros((2, len(raw)), np.int64)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOCK, side="right")) - 1)
        n[lo:hi], cuts[:, lo:hi] = cut_places(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], draws[:, lo:hi])
        lo = hi
    fields = {"n": n, "first": cuts.min(0), "second": cuts.max(0)}
    return pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))


def unit_cuts(text: Column, one: Column, two: Column) -> Column:
    """Struct (n, first, second): units of a text, and the code points before the lower and the higher of two cuts at ``one`` and ``two`` modulo n + 1 units.

    A unit is a run of ASCII letters or any other code point.
    """

    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return _cut_texts(texts, one, two)

    return F.arrow_udf(run, "n long, first long, second long")(F.coalesce(text.cast("string"), F.lit("")), one, two)


def _draw(seed: int, key: str, group: int) -> Column:
    """An unsigned 32-bit number of (seed, key): the ``group``-th eight digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, percent: int = 90, suffix_first: int = 20, seed: int = 1, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    Both cuts are uniform over the unit boundaries by the digest of seed and id. ``percent`` of the texts are rewritten: prefix, suffix, middle
    (psm), or of those a share of ``suffix_first`` percent suffix, prefix, middle (spm). Others stay plain, and so do empty and null texts (output is
    empty) and texts that hold one of the ``marks``, which couldn't be undone. A null id draws as the empty one; repeated ids
    draw alike; other columns are dropped; each row gives one row.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("cut", unit_cuts(F.col("text"), _draw(seed, "doc_id", 1), _draw(seed, "doc_id", 2)))
    held = F.lit(False)
    for m in marks:
        held = held | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | held | (_draw(seed, "doc_id", 3) % 100 >= percent), "plain").when(_draw(seed, "doc_id", 4) % 100 < suffix_first, "spm").otherwise("psm")
    a, b = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    part = lambda lo, n: F.substr("text", lo + 1, n)
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.length("text"))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.first")).alias("prefix_chars"), F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text again. No mark can stand before its own place, since the text holds none and a mark can't begin within another."""
    import re

    parts = F.split(output, "|".join(map(re.escape, marks)))
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
