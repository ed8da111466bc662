"""Classifiers and rates against plain versions that take one text at a time."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from seqspark.llm import ann, ball_tree, lang_id, mixing, toxicity, vectors
from seqspark.llm.common import _hash_block

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").cache()


def plain_language(model, text):
    if not any(c.isalpha() for c in text):
        return "und"
    data, mask, counts = b" " + text.lower().encode() + b" ", 0xFFFFFFFF, np.zeros(lang_id.BUCKETS)
    for n in lang_id.ORDERS:
        for i in range(len(data) - n + 1):
            h = n * 2654435769 & mask
            for b in data[i : i + n]:
                h = (h ^ b) * 0x01000193 & mask
            h ^= h >> 15
            counts[(h * 0x9E3779B1 & mask) >> 19] += 1
    x = np.sqrt(counts)
    margins = x / np.linalg.norm(x) @ model.weights
    losses = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, code, strict=True)) for code in model.code]
    return model.languages[int(np.argmin(losses))]


def test_language_of_each_text(docs):
    model = lang_id.fit_languages(docs)
    rows = docs.select("doc_id", "text").limit(60)
    text = dict(rows.collect())
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(rows, model).collect()}
    assert got == {k: plain_language(model, t or "") for k, t in text.items()}


def plain_toxicity(model, text):
    found = set()
    for word in text.encode().translate(toxicity._MARKS).lower().split():
        for k, p in enumerate(toxicity.PREFIXES):
            found.add(int(_hash_block(word, p)[0][0] ^ toxicity._salt(k)))
    weight = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    return 1 / (1 + math.exp(-model.bias - sum(weight.get(h, 0) for h in found)))


def test_toxicity_of_each_text(spark, docs):
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "idiot " * 200_000), (-3, "same"), (-3, "same")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").limit(60).unionByName(extra)
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.score_toxicity(rows.withColumn("score", F.lit("x")), model).collect())
    assert got == [(k, pytest.approx(s, abs=1e-9)) for k, s in sorted((r.doc_id or 0, plain_toxicity(model, r.text or "")) for r in rows.collect())]
    assert toxicity.score_toxicity(rows.limit(0), model).count() == 0


def test_rates_of_each_text(spark):
    words = {"a": "red blue green", "b": "one two three", "c": "up down left"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]].split() + ["and"], rng.integers(1, 30))), "abc"[i % 3]) for i in range(45)]
    docs = spark.createDataFrame([*rows, (99, "", None), (None, None, None)], "doc_id long, text string, domain string")
    mixer = mixing.fit_mixture(docs, docs.where("domain is not null and doc_id < 30"), {"a": 3, "b": 1, "c": 1})
    got = {r.doc_id: r for r in mixing.document_rates(mixer).collect()}
    tf = HashingTF(numFeatures=mixing.BUCKETS)
    pi, theta = mixer.model.pi.toArray(), mixer.model.theta.toArray()
    n, p = [], []
    for i, text, _ in rows:
        score = pi + sum(theta[:, tf.indexOf(w)] for w in text.split())
        soft = np.exp(mixer.softness * (score - score.max()))
        n.append(len(text.split()))
        p.append(soft / soft.sum())
        assert got[i].posterior == pytest.approx(p[-1], rel=1e-9) and got[i].n_tokens == n[-1]
    # Rates by plain projected gradient steps with the same metric.
    n, p = np.array(n, float), np.array(p)
    gram = (p * n[:, None]).T @ p
    mass, total = gram.sum(1), n.sum()
    want = total * np.array([0.6, 0.2, 0.2])
    metric = np.linalg.pinv(gram + 1e-3 * np.diag(mass) + 1e-12 * total * np.eye(3))
    r = y = np.ones(len(n))
    for step in range(len(mixer.steps)):
        new = np.maximum(0, y - p @ (metric @ ((y * n) @ p - want)))
        r, y = new, new + step / (step + 3) * (new - r)
    assert [got[i].rate for i, _, _ in rows] == pytest.approx(r, abs=1e-6)
    assert (r * n) @ p == pytest.approx(want, rel=0.01) and got[99].rate == got[None].rate == 1


def test_search_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    x = vectors.valid_vectors(none, zero_too=False)
    assert ann.approximate_neighbours(x, x, ann.fit_partitions(x), 20, 1).count() == 0
    some = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    q = ball_tree.quantised(vectors.valid_vectors(some))
    share = ball_tree.visited(q, q.where("vec_id < 4"), 2, shard_rows=8).first()
    assert 0 < share.share <= 1


def test_ties_go_to_the_smaller_id(spark):
    """Many points tie at the last place, far more than are asked for."""
    rows = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)] + [float(i // 4 % 100) * 1e-3]) for i in range(800)]
    x = vectors.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.approximate_neighbours(x, x.where("vec_id in (0, 20)"), ann.fit_partitions(x, n_parts=2), 20, 2).collect()
    m = np.array([v for _, v in rows])
    for q in (0, 20):
        s = (m * m[q]).sum(1)
        best = sorted((j for j in range(800) if j != q), key=lambda j: (-s[j], j))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best
