"""Approximate nearest neighbours with learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small network learns from a vector how its neighbours are spread over
the parts. Every row is stored with the part that the network deems likeliest; a query visits its likeliest parts, where inner products are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import scratch, written
from seqspark.llm.vectors import best, by_name, by_row, distinct_vectors, each_pair, packed, unpacked

FOUND = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows with the largest inner products with each row."""
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, n_parts: int, seed: int = 3, sweeps: int = 6) -> np.ndarray:
    """Parts of equal size with few edges between them: repeated halving along the graph's slowest wave, then swaps that gain edges."""
    n, rng = len(graph), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(int(np.log2(n_parts))):
        halves = part.copy()
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            u, v = place[a[inside]], place[b[inside]]
            degree = np.bincount(u, minlength=len(own)) + np.bincount(v, minlength=len(own)) + 1e-9
            wave = rng.standard_normal(len(own))
            for _ in range(60):
                wave -= (wave * degree).sum() / degree.sum()
                step = (np.bincount(u, wave[v], len(own)) + np.bincount(v, wave[u], len(own))) / degree
                wave = 0.5 * wave + 0.5 * step
                wave /= np.abs(wave).max() + 1e-12
            side = np.zeros(len(own), np.int64)
            side[np.argsort(wave, kind="stable")[len(own) // 2 :]] = 1
            for _ in range(sweeps):
                to = np.bincount(u, side[v], len(own)) + np.bincount(v, side[u], len(own))
                gain = np.where(side == 0, 2 * to - degree, degree - 2 * to)  # edges won by changing sides
                zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                zero, one = zero[np.argsort(-gain[zero])], one[np.argsort(-gain[one])]
                m = min(len(zero), len(one))
                swap = np.flatnonzero((gain[zero[:m]] + gain[one[:m]] > 2) & (rng.random(m) < 0.5))
                if not len(swap):
                    break
                side[zero[swap]], side[one[swap]] = 1, 0
            halves[own] = 2 * p + side
        part = halves
    return part


@dataclass
class Router:
    """A network with one hidden layer; its outputs are the parts' log odds."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 400, seed: int = 5) -> Router:
    """Cross-entropy against soft targets, by Adam over random batches."""
    rng = np.random.default_rng(seed)
    d, k = x.shape[1], target.shape[1]
    scale = float(np.sqrt(d) / max(np.sqrt((x**2).sum(1)).mean(), 1e-12))
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, k)) * np.sqrt(1 / hidden), np.zeros(k)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(512, len(x)))
        h0 = x[at] * scale @ p[0] + p[1]
        h = np.maximum(h0, 0)
        o = h @ p[2] + p[3]
        e = np.exp(o - o.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - target[at]) / len(at)
        gh = (g @ p[2].T) * (h0 > 0)
        for i, grad in enumerate((x[at].T @ gh * scale + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum(0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            p[i] = p[i] - 0.01 * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale)


def fit_partitions(vectors: DataFrame, n_parts: int | None = None, sample_rows: int = 8192, neighbours: int = 20, part_rows: int = 4096) -> Router:
    """Learns parts from at most ``sample_rows`` vectors, those with the least hash of their id.

    Parts grow with the table: the power of two that gives each about ``part_rows`` rows, of those from 16 on that leave 32 rows of the sample to each. With fewer
    than 4 vectors for each part there is one part, so that the search is exact.
    """
    if n_parts is None:
        most = max(16, 1 << int(np.log2(max(sample_rows // 32, 1))))
        n_parts = min(most, max(16, 1 << int(np.ceil(np.log2(max(vectors.count() / part_rows, 1))))))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(sample_rows).select("vector").toArrow()
    x = np.array(sample.column(0).to_pylist(), np.float64)
    if len(x) < 4 * n_parts:
        d = x.shape[1] if len(x) else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbour_graph(x, min(neighbours, len(x) - 1))
    part = balanced_parts(graph, n_parts)
    target = np.eye(n_parts)[part][graph].sum(1) + np.eye(n_parts)[part]
    return train_router(x, target / target.sum(1, keepdims=True))


def _routed(df: DataFrame, router: Router, n: int) -> DataFrame:
    """(vec_id, vector) once for each of the n likeliest parts."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.asarray(b.column(1).flatten())
            odds = router.odds(flat.reshape(b.num_rows, -1))
            parts = np.argsort(-odds, 1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "vector", "parts"])

    return df.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, parts array<int>").select("vec_id", "vector", F.explode("parts").alias("part"))


def _search(k: int) -> Callable[[str, str], pd.DataFrame]:
    def run(stored: str, asked: str) -> pd.DataFrame:
        query_ids, queries, _ = unpacked(asked)
        ids, matrix, _ = unpacked(stored)
        points, flat, count = distinct_vectors(ids, matrix, k + 1)
        start = np.cumsum(count) - count
        out_q, out_v, out_s = [], [], []
        width = min(len(points), k + 1)
        size = np.sqrt((points**2).sum(1)).max(initial=0)
        for lo in range(0, len(queries), 256):
            q = queries[lo : lo + 256]
            rough = q @ points.T
            # All that may be among the best k + 1 points, however the products were rounded; ties at the last place included.
            least = np.partition(rough, len(points) - width, axis=1)[:, len(points) - width]
            margin = 4 * points.shape[1] * np.finfo(float).eps * np.sqrt((q**2).sum(1)) * size
            for i in range(len(q)):
                near = np.flatnonzero(rough[i] >= least[i] - margin[i])
                # A sum in one order for all rows: equal vectors have equal scores wherever they stand.
                exact = (points[near] * q[i]).sum(-1)
                n = count[near]
                v = flat[np.arange(n.sum()) + np.repeat(start[near] - (np.cumsum(n) - n), n)]
                s = np.repeat(exact, n)
                other = v != query_ids[lo + i]
                v, s = v[other], s[other]
                order = np.lexsort((v, -s))[:k]
                out_q.append(np.full(len(order), query_ids[lo + i]))
                out_v.append(v[order])
                out_s.append(s[order])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def probes_of(router: Router, share: float = 0.8125) -> int:
    """How many parts are visited: a share of them, rounded up. The default is 13 of 16."""
    return int(np.ceil(share * len(router.b2)))


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, router: Router, k: int, probes: int, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found in each query's ``probes`` likeliest parts.

    Both tables have (vec_id, vector), and row where ids repeat, as ``valid_vectors`` gives them; further columns are ignored; every row is indexed. A query's own id is no candidate, ties
    go to the smaller id. Parts and their queries are cut into blocks by a hash of the id, however uneven the parts; a block is a file in the shared folder, and
    each pair of blocks one task's work. Where the visited parts hold fewer than k candidates, ``probes`` should be raised: with as many as there are parts
    the search is exact. Empty inputs give an empty result.
    """
    base, all_rows = scratch(vectors.sparkSession, "ann"), vectors
    vectors, queries, n_parts = by_row(vectors), by_row(queries), len(router.b2)

    def blocks(df: DataFrame, n: int, rows: int, salt: int, name: str) -> DataFrame:
        routed = written(_routed(df, router, n), f"{base}/{name}-rows")
        sizes = routed.groupBy("part").agg(F.ceil(F.count("*") / rows).alias("n_blocks"))
        block = F.col("part") + n_parts * F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("n_blocks"))
        # As few rows as parts, and those are bounded by the sample.
        return packed(routed.join(F.broadcast(sizes), "part"), block, f"{base}/{name}").withColumn("part", F.pmod("block", F.lit(n_parts)))

    stored = blocks(vectors, 1, block_rows, 1, "stored").select("part", F.col("uri").alias("left"))
    asked = blocks(queries, min(probes, n_parts), query_rows, 2, "asked").select("part", F.col("uri").alias("right"))
    pairs = written(stored.join(asked, "part").select("left", "right"), f"{base}/pairs")
    return by_name(best(each_pair(pairs, pairs.count(), _search(k), FOUND), k), all_rows)
