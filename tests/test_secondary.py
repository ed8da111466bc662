"""Secondary structure against a plain version, and on an ideal helix."""

import numpy as np
import pytest

from seqspark.operators import secondary

ATOMS = "structure_id string, chain string, res_seq int, line_no int, atom_name string, x double, y double, z double"
HELIX = (("N", 1.566, -26.65, -0.916), ("CA", 2.291, 0.0, 0.0), ("C", 1.68, 26.9, 1.058), ("O", 1.934, 20.68, 2.247))


def helix(n):
    k = np.arange(n)
    return np.array([[r * np.cos(np.radians(98.93 * k + a)), r * np.sin(np.radians(98.93 * k + a)), 1.541 * k + z] for _, r, a, z in HELIX]).transpose(2, 0, 1)


def cloud(n, seed, size=4.0):
    rng = np.random.default_rng(seed)
    out = rng.normal(0, size, (n, 1, 3)) + np.cumsum(rng.normal(0, 0.8, (n, 4, 3)), 1)
    d = rng.normal(0, 1, (n, 3))
    out[:, 3] = out[:, 2] + 1.23 * d / np.linalg.norm(d, axis=1, keepdims=True)
    return out


def rows(name, chain, residues, without=()):
    return [(name, chain, 3 + k, 4 * k + i, a, *map(float, residues[k, i])) for k in range(len(residues)) for i, (a, *_) in enumerate(HELIX) if (k, a) not in without]


def plain(x):
    """States of residues with all atoms (n, 4, 3), by whole matrices of bonds."""
    n = len(x)
    unit = lambda v: v / np.linalg.norm(v)
    bond = np.zeros((n + 6, n + 6), bool)
    for j in range(1, n):
        h = x[j, 0] + 1.01 * unit(unit(x[j, 0] - x[j - 1, 2]) + unit(x[j, 0] - x[j, 1]))
        for i in range(n - 1):
            if j - i not in (0, 1, 2):
                d = lambda a, b: np.linalg.norm(a - b)
                bond[i, j] = 27.888 * (1 / d(x[i, 3], x[j, 0]) + 1 / d(x[i, 2], h) - 1 / d(x[i, 3], h) - 1 / d(x[i, 2], x[j, 0])) < -0.5
    begins = {s: [k >= 1 and bool(bond[k, k + s]) and bool(bond[k - 1, k - 1 + s]) for k in range(n)] for s in (3, 4, 5)}
    reach = lambda b, s: [any(b[max(0, k - s + 1) : k + 1]) for k in range(n)]
    h4 = reach(begins[4], 4)
    free = [not h4[k] and not (k + 1 < n and h4[k + 1]) for k in range(n)]
    h3, h5 = (reach([b and f for b, f in zip(begins[s], free, strict=True)], s) for s in (3, 5))
    states = []
    for i in range(n):
        pairs = [j for j in range(1, n - 1) if 1 <= i <= n - 2 and ((bond[i - 1, j] and bond[j, i + 1]) or (bond[j - 1, i] and bond[i, j + 1]) or (bond[i, j] and bond[j, i]) or (bond[i - 1, j + 1] and bond[j - 1, i + 1]))]
        states.append("helix" if h4[i] or h3[i] or h5[i] else "sheet" if pairs else "loop")
    return states


def test_states(spark):
    made = {("a", "A"): helix(20), ("a", "B"): cloud(40, 1), ("b", "A"): cloud(60, 2, 3.0), ("b", "C"): cloud(25, 3, 2.5), ("c", "A"): cloud(1, 4), ("c", "B"): cloud(2, 5)}
    without = {(5, "O"), (9, "CA")}
    atoms = spark.createDataFrame([r for (s, c), x in made.items() for r in rows(s, c, x, without if (s, c) == ("b", "A") else ())], ATOMS)
    got = secondary.secondary_structure(secondary.backbone(atoms)).collect()
    states = {key: [r.state for r in sorted((r for r in got if (r.structure_id, r.chain) == key), key=lambda r: r.k)] for key in made}
    expected = {key: plain(np.delete(x, [5, 9], 0) if key == ("b", "A") else x) for key, x in made.items()}
    assert states == expected
    assert states["a", "A"][1:19] == ["helix"] * 18 or states["a", "A"].count("helix") >= 16
    assert {s for v in states.values() for s in v} == {"helix", "sheet", "loop"}


def test_fractions(spark):
    atoms = spark.createDataFrame(rows("a", "B", helix(12)) + rows("a", "A", cloud(9, 7)) + [("d", "B", 1, 0, "N", 0.0, 0.0, 0.0)], ATOMS)
    got = secondary.secondary_fractions(atoms, "B").collect()
    assert [(r.structure_id, r.chain, r.n_residues) for r in got] == [("a", "B", 12)]
    assert got[0].helix_fraction > 0.6 and got[0].helix_fraction + got[0].sheet_fraction + got[0].loop_fraction == pytest.approx(1)
    assert secondary.secondary_fractions(atoms.limit(0)).count() == 0
