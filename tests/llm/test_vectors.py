"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from seqspark.llm import ann, ball_tree, queries, vectors


def rows(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 : n // 2 + 30] = x[0]
    return [(int(i), v.tolist(), "x") for i, v in enumerate(x)]


@pytest.mark.parametrize("shard", [16, 1000])
def test_top_products_are_exact(spark, shard):
    data = rows(400, 6, 1)
    bad = [(900, None, "x"), (901, [1.0] * 5 + [float("nan")], "x"), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (903, [1.0], "x"), (None, [9.0] * 6, "x"), data[3]]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, score string")
    x = ball_tree.quantised(vectors.valid_vectors(df))
    got = ball_tree.top_inner_products(x, x.where("vec_id % 50 = 0"), 5, shard_rows=shard, block_rows=3).collect()
    q = np.floor(256 * np.array([v for _, v, _ in data], np.float32).astype(float))
    for i in range(0, 400, 50):
        s = q @ q[i]
        best = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == [(j, int(s[j])) for j in best]
    assert len(got) == 40


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5])], "vec_id long, embedding array<float>")
    x = ball_tree.quantised(vectors.valid_vectors(df))
    assert ball_tree.top_inner_products(x, x, 5).count() == 2
    assert ball_tree.top_inner_products(x.limit(0), x.limit(0), 5).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in queries.op9_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = np.argsort(-s, kind="stable")[:20]
        mine = got[ids[k]]
        assert len(mine) == 20
        recall.append(len(set(ids[best].tolist()) & set(mine)) / 20)
        assert all(abs(mine[v] - x[np.searchsorted(ids, v)] @ x[k]) < 1e-12 for v in mine)
    assert np.mean(recall) >= 0.9


def test_visiting_all_parts_is_exact(spark):
    data = rows(300, 5, 2)
    df = spark.createDataFrame([*data, (999, [0.0] * 5, "x")], "vec_id long, embedding array<float>, part string")
    x = vectors.valid_vectors(df, zero_too=False)
    router = ann.fit_partitions(x, n_parts=4)
    got = ann.approximate_neighbours(x, x.where("vec_id % 20 = 0"), router, 20, 4, block_rows=64, query_rows=4).collect()
    q = np.array([v for _, v, _ in data], np.float32).astype(float)
    for i in range(0, 300, 20):
        s = (q * q[i]).sum(1)
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == best
