"""Column helpers: hash uniforms, normal variates and the normal distribution, letter counts, vector distance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# Hart's rational approximation of the normal distribution (Hart 1968; West 2005), highest power first.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in (0, 1) that depends on seed and key alone: neither on partitions nor on retries."""
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    head = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns))), 1, 8)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, *key: Column | str) -> Column:
    """A standard normal number of the key alone (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(seed, *key, F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, *key, F.lit("b")))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    polynomial = lambda c: reduce(lambda s, a: s * x + a, c[1:], F.lit(c[0]))
    tail = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    upper = F.when(x < 7.07106781186547, e * polynomial(HART_P) / polynomial(HART_Q)).otherwise(e / (tail * 2.506628274631))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def count_letter(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def count_letters(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two double arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
