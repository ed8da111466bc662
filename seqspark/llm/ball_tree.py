"""Exact search for the largest inner products: a ball tree for each shard, searched by branch and bound.

No query q scores more than q.c + |q| r within a ball of centre c and radius r. Nodes are visited in the order of that bound and only by the
queries of a block whose k-th score so far doesn't exceed it. The k-th scores are shared: shards are searched in waves, the first of one shard for each block
of queries, and what a wave finds bounds the search of the next. Trees and blocks of queries are files in the shared folder; pairs of them are rows of names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import map_file, scratch, write_file, written
from seqspark.llm.vectors import best, by_name, by_row, distinct_vectors, each_pair, packed, unpacked, valid_vectors

FOUND = "query_id long, vec_id long, score long"
#: Waves after the first: the share of the shards that is searched by the end of each.
WAVES = (0.125, 1.0)


@dataclass
class BallTree:
    """Nodes in an array; points in leaf order. Equal points are one point with its smallest ids."""

    centre: np.ndarray
    radius: np.ndarray
    span: np.ndarray
    child: np.ndarray
    points: np.ndarray
    ids: np.ndarray
    id_start: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, matrix: np.ndarray, most: int, leaf: int = 64) -> BallTree:
        points, flat, count = distinct_vectors(ids, matrix, most)
        order = np.arange(len(points))
        centre, radius, span, child = [], [], [], []

        def node(lo: int, hi: int) -> int:
            c = points[order[lo:hi]].mean(0)
            centre.append(c)
            radius.append(np.sqrt(((points[order[lo:hi]] - c) ** 2).sum(1).max()))
            span.append((lo, hi))
            child.append((-1, -1))
            return len(centre) - 1

        todo = [node(0, len(points))]
        while todo:
            k = todo.pop()
            lo, hi = span[k]
            if hi - lo > leaf:
                own = points[order[lo:hi]]
                a = own[((own - centre[k]) ** 2).sum(1).argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                order[lo:hi] = order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
                child[k] = node(lo, (lo + hi) // 2), node((lo + hi) // 2, hi)
                todo += child[k]
        start = np.cumsum(count) - count
        flat = np.concatenate([flat[start[i] : start[i] + count[i]] for i in order])
        return cls(np.array(centre), np.array(radius), np.array(span), np.array(child), points[order], flat, np.concatenate(([0], np.cumsum(count[order]))))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, id, score) triples that hold the shard's share of each query's best k, and how many products were formed; scores below ``bound`` are left out."""
        n, formed = len(queries), 0
        score, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        kth = bound.copy()
        upper = queries @ self.centre.T + np.sqrt((queries**2).sum(1))[:, None] * self.radius[None]
        upper += 1e-9 * np.abs(upper) + 1e-6
        stack = [(0, np.arange(n))]
        while stack:
            at, active = stack.pop()
            active = active[upper[active, at] >= kth[active]]
            if not len(active):
                continue
            left, right = self.child[at]
            if left >= 0:
                first, second = (left, right) if upper[active, left].sum() >= upper[active, right].sum() else (right, left)
                stack += [(second, active), (first, active)]
                continue
            lo, hi = self.span[at]
            ids = self.ids[self.id_start[lo] : self.id_start[hi]]
            formed += len(active) * int(hi - lo)
            s = np.repeat(queries[active] @ self.points[lo:hi].T, np.diff(self.id_start[lo : hi + 1]), axis=1)
            s[query_ids[active][:, None] == ids[None]] = -np.inf
            some = s.max(1) >= kth[active]
            active, s = active[some], s[some]
            if len(active):
                s = np.concatenate((score[active], s), 1)
                i = np.concatenate((who[active], np.broadcast_to(ids, (len(active), len(ids)))), 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                score[active], who[active] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                kth[active] = np.maximum(bound[active], score[active, -1])
        q, j = np.nonzero((score > -np.inf) & (score >= bound[:, None]))
        return query_ids[q], who[q, j], score[q, j], formed


@lru_cache(maxsize=1)
def _tree(uri: str) -> BallTree:
    return pickle.loads(map_file(uri).tobytes())


def _search(k: int, count: bool = False) -> Callable[[str, str], pd.DataFrame]:
    def run(tree: str, block: str) -> pd.DataFrame:
        q, v, s, formed = _tree(tree).search(*unpacked(block), k)
        if count:
            return pd.DataFrame({"formed": [formed], "possible": [len(_tree(tree).points) * len(unpacked(block)[0])]})
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s.astype(np.int64)})

    return run


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """Components as floor(scale * x)."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("double")))


def _by_id(n: int, salt: int):
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))


def _waves(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int, block_rows: int, count: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """What all waves found, each a written table; and, to ``count``, the products that each pair formed and could have formed."""
    base = scratch(vectors.sparkSession, "ball-tree")
    n_shards = vectors.count() // shard_rows + 1
    n_blocks = queries.count() // block_rows + 1

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree.build(rows["vec_id"].to_numpy(np.int64), np.array(rows["vector"].tolist(), np.float64), k + 1)
        return pd.DataFrame([{"shard": key[0], "uri": write_file(f"{base}/files", f"tree-{key[0]}", [pickle.dumps(tree, protocol=5)])}])

    trees = written(vectors.withColumn("shard", _by_id(n_shards, 1)).groupBy("shard").applyInPandas(build, "shard long, uri string"), f"{base}/trees")
    found = counted = None
    done = 0
    for wave, upto in enumerate((1, *(max(1, int(n_shards * w)) for w in WAVES))):
        if upto <= done:
            continue
        bounded = queries.withColumn("bound", F.lit(float("-inf")))
        if found is not None:
            kth = best(found, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            bounded = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "vector", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("bound"))
        blocks = packed(bounded, _by_id(n_blocks, 2), f"{base}/queries-{wave}", bound=True).select("block", F.col("uri").alias("right"))
        # A block begins with the shard of its own number and goes on from there, so that the first wave meets all shards alike.
        shards = F.explode(F.transform(F.sequence(F.lit(done), F.lit(upto - 1)), lambda i: F.pmod(F.col("block") + i, F.lit(n_shards)))).alias("shard")
        pairs = blocks.select("right", shards).join(trees.select("shard", F.col("uri").alias("left")), "shard")
        new = written(each_pair(pairs, n_blocks * (upto - done), _search(k), FOUND), f"{base}/found-{wave}")
        found = new if found is None else found.unionByName(new)
        if count:
            more = written(each_pair(pairs, n_blocks * (upto - done), _search(k, True), "formed long, possible long"), f"{base}/counted-{wave}")
            counted = more if counted is None else counted.unionByName(more)
        done = upto
    return found, counted


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``vectors`` (vec_id, vector) with the largest integer inner products.

    A query's own id is no candidate; ties go to the smaller id; all candidates are returned where they are fewer. Components are integers whose products sum to less
    than 2**53 in all, so the arithmetic is exact. Ids are not null, and unique but where ``valid_vectors`` numbers the rows: then each row is a query or candidate of its own. Further columns are ignored. Empty inputs give an empty result.
    Shards and blocks of queries are dealt out by a hash of the id, and each pair of them is one task's work.
    """
    return by_name(best(_waves(by_row(vectors), by_row(queries), k, shard_rows, block_rows)[0], k), vectors)


def visited(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """One row: the inner products with points that the search forms, those of all pairs, and their share."""
    _, counted = _waves(by_row(vectors), by_row(queries), k, shard_rows, block_rows, count=True)
    return counted.agg(F.sum("formed").alias("formed"), F.sum("possible").alias("possible"), F.try_divide(F.sum("formed"), F.sum("possible")).alias("share"))


__all__ = ["BallTree", "quantised", "top_inner_products", "valid_vectors", "visited"]
