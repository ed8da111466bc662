"""Mixing meets its targets; the pipeline's stages do what they say."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqspark.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_rates_meet_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = docs.select("doc_id", F.col("lang").alias("domain"))
    wanted = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    mixer = mixing.fit_mixture(docs, labels, wanted)
    rows = mixing.document_rates(mixer).collect()
    p, n, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert (r >= 0).all()
    reached = (p * (n * r)[:, None]).sum(0)
    assert reached / n.sum() == pytest.approx([wanted[d] for d in mixer.domains], rel=0.01)
    words = {d.doc_id: len(d.text.encode().split()) for d in docs.collect()}
    assert all(words[x.doc_id] == x.n_tokens for x in rows)
    lang = {d.doc_id: d.lang for d in docs.collect()}
    assert np.mean([mixer.domains[int(np.argmax(x.posterior))] == lang[x.doc_id] for x in rows if x.n_tokens > 20]) > 0.9


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (2, "", 9), (2, "c c c", 9), (2, "c c c", 9)], "doc_id long, text string, rate int")
    mixer = mixing.fit_mixture(docs, spark.createDataFrame([(None, "x"), (77, "y")], "doc_id long, domain string"))
    assert mixing.mixed(docs, mixer).columns == docs.columns and mixing.mixed(docs, mixer).count() == 5
    assert mixing.mixed(docs.limit(0), mixing.fit_mixture(docs.limit(0), docs.select("doc_id", F.lit("a").alias("domain")))).count() == 0


def test_domains_of_any_language(spark):
    words = {"ru": "это он не на что как мы вы был они", "uk": "це він не на що як ми ви був вони", "el": "και το να είναι με για που από στο την", "it": "il che non per una sono con del gli anche", "zh": "这是我的书我们不知道他在哪里"}
    rng = np.random.default_rng(3)
    text = lambda k: ("" if k == "zh" else " ").join(rng.choice(list(words[k]) if k == "zh" else words[k].split(), 25))
    rows = [(i, text(k), k) for i, k in enumerate([*words] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    mixer = mixing.fit_mixture(docs, docs.where("doc_id < 100"))
    right = [mixer.domains[int(np.argmax(r.posterior))] == rows[r.doc_id][2] for r in mixing.document_rates(mixer).collect() if r.doc_id >= 100]
    assert len(right) == 100 and np.mean(right) > 0.97


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123", "en", "s", 3), (-3, "you idiot moron scum worthless pathetic loser", "en", "s", 9), (None, "and the of to shat", "en", "s", 5)], docs.schema)
    at = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "mixing", "bpe_tokens"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert not kept[0] & {-1, -2} and -3 in kept[0] and None in kept[2]
    assert -3 not in kept[1]
    assert len(kept[0] - kept[1]) < 0.2 * len(kept[0])
    texts = [r.text for r in at.collect()]
    assert len(texts) == len(set(texts))
    tokens = corpus_pipeline.STAGES[4][1](spark, at, SF).collect()
    assert sorted(r.decoded_sha256 for r in tokens) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    mixed = corpus_pipeline.STAGES[3][1](spark, at, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0.5 * len(texts)


def test_run(spark):
    rows = queries.pipeline(spark, SF)
    assert rows.count() > 0 and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
