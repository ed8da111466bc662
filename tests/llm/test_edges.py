"""Odd inputs of each operator: very long texts, clashing columns, repeated and empty rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqspark.llm import ann, ball_tree, kn_lm, lang_id, mixing, vectors, warc

SF = "/root/testdata/sf0.001"


def test_language_model_of_long_texts_and_clashing_columns(spark):
    long = "the cat sat on a mat " * 60_000
    rows = [(1, "the cat sat"), (2, long), (2, long), (None, None), (4, "x" * 300_000), (5, "")]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, text string, score int, n_tokens string")
    model = kn_lm.count_ngrams(df)
    assert model.tokens == sum(len((t or "").split()) + 1 for _, t in rows)
    got = kn_lm.score_texts(df, model)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    found = got.collect()
    assert sorted(r.n_tokens for r in found) == sorted(len((t or "").split()) + 1 for _, t in rows) and all(math.isfinite(r.score) for r in found)
    twice = [r.score for r in found if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert kn_lm.score_texts(df.limit(0), model).count() == 0


def test_selections_of_records(spark):
    pages = spark.createDataFrame([(i, f"http://{i}", f"<p>{i % 3}</p>", "x") for i in range(9)], "page_id long, url string, html string, record_type string")
    index = warc.write_archives(pages)
    assert warc.read_records(index.limit(0)).count() == 0
    some = index.where("page_id < 4").withColumn("payload", F.lit("clash"))
    assert warc.read_records(some.unionByName(some)).count() == 4


def test_mixing_of_a_long_text(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["red", "blue"]) for _ in range(300_000))
    docs = spark.createDataFrame([(i, "red blue red" if i % 2 else "one two three", "x") for i in range(40)] + [(99, long, "x"), (100, "z" * 200_000, "x")], "doc_id long, text string, copies string")
    mixer = mixing.fit_mixture(docs, docs.where("doc_id < 30").select("doc_id", (F.col("doc_id") % 2).cast("string").alias("domain")), {"0": 1, "1": 1})
    rates = {r.doc_id: r for r in mixing.document_rates(mixer).collect()}
    assert rates[99].n_tokens == 300_000 and mixer.domains[int(np.argmax(rates[99].posterior))] == "1"
    assert mixing.mixed(docs, mixer).columns == docs.columns


def test_mixing_of_many_domains(spark):
    """Hundreds of domains, whose products would be tens of thousands of sums."""
    docs = spark.range(600).selectExpr("id doc_id", "concat_ws(' ', 'w' || (id % 150), 'v' || (id % 150), 'all', 'all') text")
    mixer = mixing.fit_mixture(docs, docs.selectExpr("doc_id", "'d' || (doc_id % 150) domain"), {f"d{i}": 1 + i % 3 for i in range(150)}, most_steps=3)
    assert len(mixer.domains) == 150 and sum(mixer.mass) == pytest.approx(2400) and sum(mixer.targets) == pytest.approx(2400)
    rates = mixing.document_rates(mixer)
    assert rates.count() == 600


def test_vectors_that_repeat_an_id(spark):
    """Rows with one id and different vectors are queries and candidates of their own; exact repeats and vectors of uncommon lengths are not."""
    rows = [(i, [float(i % 7), 1.0, 2.0]) for i in range(60)] + [(3, [9.0, 9.0, 9.0]), (4, [8.0, 1.0, 2.0]), (3, [3.0, 1.0, 2.0]), (77, [1.0, 2.0]), (78, [5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    x = vectors.valid_vectors(df)
    kept = rows[:62]
    assert sorted((r.vec_id, r.vector) for r in x.collect()) == sorted(kept) and [r.vec_id for r in x.orderBy("row").collect()] == sorted(i for i, _ in kept)
    q = x.withColumn("vector", F.transform("vector", lambda c: 256 * c))
    exact = ball_tree.top_inner_products(q, q.where("vec_id in (3, 10)"), 5).collect()
    near = ann.approximate_neighbours(x, x.where("vec_id in (3, 10)"), ann.fit_partitions(x, n_parts=1), 5, 1).collect()
    expected = []
    for at, (i, v) in enumerate(kept):
        if i in (3, 10):
            best = sorted(((-sum(a * b for a, b in zip(w, v, strict=True)), j) for k, (j, w) in enumerate(kept) if k != at))[:5]
            expected += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score / 65536) for r in exact) == sorted(expected)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in near) == sorted(expected)


def test_languages_of_long_texts_ties_and_clashing_columns(spark):
    en, de = "the house and the garden of it ", "das haus und der garten von ihm "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de", 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = lang_id.fit_languages(df)
    long = en * 180_000  # over the size that features are counted at once
    odd = spark.createDataFrame([(1, long, None, 0.0), (2, de * 40_000, None, 0.0), (2, de, None, 0.0), (2, de, None, 0.0), (None, "", None, 0.0)], df.schema)
    got = lang_id.identify(odd, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "ambiguous"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got.collect()) == [(0, "und"), (1, "en"), (2, "de"), (2, "de"), (2, "de")]
    whole = lang_id.features([long])
    parts = lang_id.features([en * 1000])
    assert np.allclose(whole, parts, atol=0.02)
    assert lang_id.identify(odd.limit(0), model).count() == 0


def test_run_of_odd_documents(spark, tmp_path):
    """run() over a table with nulls, repeats and long texts, and over an empty one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = docs.where("length(text) between 200 and 4000 and text rlike '^[A-Za-z ]{40}'").limit(30)
    first = sample.orderBy("doc_id").first()
    odd = spark.createDataFrame([(None, None, None, None, None), (None, first.text, "en", "s", 1), (first.doc_id, first.text, "en", "s", 1), (-2, "", "en", "s", 0), (-3, (first.text + " ") * 40, "en", "s", 9)], docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("odd", sample.unionByName(odd)), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    ids = {r.doc_id for r in sample.collect()}
    assert got and {r.doc_id for r in got} <= ids | {-3} and all(r.n_tokens > 0 for r in got)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
