"""Language model, language identification and toxicity against plain versions and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqspark.llm import kn_lm, lang_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_model(train, texts, order):
    """Each level's counts: of the n-grams in the text for the longest, of distinct words before the n-gram for the others."""
    words = lambda t: (t or "").encode().lower().split()
    grams = lambda t: zip(*([*[b"<s>"] * (order - 1), *words(t), None][k:] for k in range(order)), strict=False)
    uni = Counter(x for t in train for x in [*words(t), None])
    levels = [Counter(g for t in train for g in grams(t))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    of = lambda counts: kn_lm._discounts(*(sum(c == k for c in counts) for k in (1, 2, 3, 4)))
    discounts = [of(list(c.values())) for c in levels]
    totals, kinds = [Counter() for _ in levels], [defaultdict(Counter) for _ in levels]
    for counts, total, kind in zip(levels, totals, kinds, strict=True):
        for g, c in counts.items():
            total[g[:-1]] += c
            kind[g[:-1]][min(c, 3)] += 1
    n, v = sum(uni.values()), len(uni)

    def p(g, level=0):
        if level == order:
            return 1 / (v + 1)
        lower, total, c, d = p(g[1:], level + 1), totals[level][g[:-1]], levels[level][g], discounts[level]
        if not total:
            return lower
        return max(c - d[min(c, 3)], 0) / total + sum(d[k] * m for k, m in kinds[level][g[:-1]].items()) / total * lower

    out = []
    for t in texts:
        w = [*words(t), None]
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(g)) for g in grams(t))))
    return n, out, p


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("share", [64, 1])
def test_model_is_kneser_ney(spark, monkeypatch, share, order):
    """With a share of 1 every word is frequent, so followers are dealt over buckets and contexts added up."""
    monkeypatch.setattr(kn_lm, "LAYOUT_SHARE", share)
    monkeypatch.setattr(kn_lm, "FLUSH", 50)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "a", "Cat", "cat", "dog", "sat", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["the cat " * 600] * 3 + [None, "", "unseen words", "the  \n cat"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = kn_lm.count_ngrams(df.where("doc_id is not null and crc32(cast(doc_id as string)) % 10 <> 0"), order)
    n, expected, p = brute_model([t for i, t in enumerate(texts) if not held(i)], [t for _, t in rows], order)
    assert model.tokens == n and (share > 1 or len(model.layout.hot) == 2)
    got = {r.doc_id: r for r in kn_lm.score_texts(df, model).collect()}
    for (i, _), e in zip(rows, expected, strict=True):
        assert (got[i].n_tokens, got[i].n_known) == e[:2]
        assert (got[i].base_score, got[i].score) == pytest.approx(e[2:], rel=1e-9)
    everything = [b"the", b"a", b"cat", b"dog", b"sat", "é".encode(), None]
    assert sum(p((*[b"the"] * (order - 1), x)) for x in everything) <= 1 + 1e-9


@pytest.mark.parametrize("order", [2, 3])
def test_model_of_nothing(spark, order):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = kn_lm.score_texts(df, kn_lm.count_ngrams(df.limit(0), order)).first()
    assert r.n_known == 0 and math.isfinite(r.score)


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_language(spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) > 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of to", "en"), (3, None, "en"), (4, "12 .", None), (5, "²³ ①", None), (None, "the of", None)], "doc_id long, text string, lang string")
    model = lang_id.fit_languages(df)
    got = {r.doc_id: r for r in lang_id.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert lang_id.filter_languages(df, model).count() == 3
    nothing = lang_id.fit_languages(df.where("lang is null"))
    assert {r.lang_pred for r in lang_id.identify(df, nothing).collect()} == {"und"}
    assert lang_id.identify(df.limit(0), model).count() == 0


def test_language_sample_is_exact(spark):
    rows = [(None, f"alpha {i}", "aa") for i in range(700)] + [(7, f"beta {i}", "bb") for i in range(700)] + [(None, "copy", "cc")] * 500
    languages, y, x, _ = lang_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 150)
    assert languages == ["aa", "bb", "cc"] and [int((y == k).sum()) for k in range(3)] == [50, 50, 1] and len(x) == len(y)
    many = [(i, f"word {i}", f"l{i % 400}") for i in range(800)]
    languages, y, _, _ = lang_id._sample(spark.createDataFrame(many, "doc_id long, text string, lang string"), 2400)
    assert len(languages) == 400 and len(y) == 800


def test_language_filter_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit_languages(docs.where("doc_id % 2 = 0"))
    assert model.checked.all()
    strange = ["Быстрая коричневая лиса перепрыгивает через ленивую собаку и бежит дальше", "Szybki brązowy lis przeskakuje nad leniwym psem", "xkq zzvw qpx kjq wvx zqj bvk xcv qqz " * 5, "%%% ### $$$ a ### %%% 123 456 " * 80]
    junk = spark.createDataFrame([(-i, t, "en", "s", len(t)) for i, t in enumerate(strange, 1)], docs.schema)
    unseen = docs.where("doc_id % 2 = 1 and text rlike '[A-Za-z]'")
    kept = lang_id.filter_languages(unseen.unionByName(junk), model).cache()
    assert kept.where("doc_id < 0").count() == 0
    before, after = ({r.lang: r["count"] for r in x.groupBy("lang").count().collect()} for x in (unseen, kept))
    assert all(after[k] >= 0.99 * n - 1 for k, n in before.items())
    nothing = lang_id.fit_languages(docs.where("lang is null"))
    assert lang_id.filter_languages(unseen.unionByName(junk), nothing).count() == unseen.count() + len(strange)


@pytest.mark.parametrize("n", [2, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = lang_id.codewords(n)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (1 if n == 2 else 2)


def test_toxicity_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in queries.op6_toxicity(spark, SF).collect() if r.held_out and r.doc_id in toxic]
    hit = [r.predicted for r in got if toxic[r.doc_id]]
    false = [r.predicted for r in got if not toxic[r.doc_id]]
    assert np.mean(hit) > 0.5 and np.mean(false) < 0.05


def test_identity_terms_stay_neutral(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice("the sky is wide and green today with rain on old roads".split()) for _ in range(12))
    rows = [(i, (plain() + (" muslims idiot" if i % 2 else " christians") + " here"), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    gap = {}
    for fairness in (0.0, 20.0):
        model = toxicity.fit_toxicity(docs, labels, fairness=fairness)
        a, b = model.scores([b"muslims walk", b"christians walk"])
        gap[fairness] = abs(a - b)
    assert gap[20.0] < 0.5 * gap[0.0]
    assert model.scores([b"an idiot walks"])[0] > model.scores([b"a man walks"])[0]
    assert toxicity.swap_identity("The Women and he") == "The men and she"


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < 0.01 for r in toxicity.score_toxicity(docs, model).collect())
