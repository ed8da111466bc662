"""Mixing documents to target weights of domains, with soft membership. Built-in functions only.

A labelled table names the domains. Multinomial naive Bayes over hashed counts of all words of the whole lower-cased text, in any script,
gives every document a posterior over domains. Document d with n_d tokens and posterior p_d gets a rate r_d >= 0 such that the expected
tokens of domain k, t_k = sum_d r_d n_d p_dk, come to T_k. Rates minimise sum_k (t_k - T_k)^2 / m_k (m_k: tokens of domain k at
rate 1) by accelerated projected gradient from r = 1; each step is one aggregation over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import scratch, written

SPACES = " \t\n\x0b\x0c\r"
# Blocks of Unicode whose scripts are written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han); each of their characters is a word.
DENSE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: A character of those, or a run of other letters, or a run of other signs.
TERM = rf"[{DENSE}]|[\p{{L}}\p{{M}}&&[^{DENSE}]]+|[^\p{{L}}\p{{M}}\s]+"
BUCKETS = 1 << 14


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, draw and the sparse vector f of hashed word counts of the text column; an empty text has zeros."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    trimmed = F.trim(text, F.lit(SPACES))
    count = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    rows = _pinned(docs, keep, count.cast("long"), _draw(), words).withColumnsRenamed({"pin_0": "n_tokens", "pin_1": "draw", "pin_2": "words"})
    return HashingTF(numFeatures=BUCKETS, inputCol="words", outputCol="f").transform(rows).drop("words")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _draw() -> Column:
    """A uniform of a row's id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(29)), F.lit(1 << 30)) / float(1 << 30)


@dataclass
class Mixer:
    """Domains with the model of their words, and the steps that led to the rates."""

    domains: list[str]
    model: NaiveBayesModel | None
    softness: float
    targets: list[float] = field(default_factory=list)
    mass: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    steps: list[tuple[list[float], float]] = field(default_factory=list)
    rows: DataFrame | None = None

    def posteriors(self, features: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and posterior, the softmax of the log posteriors times ``softness``, of a table with the column f."""
        if self.model is None:
            return features.select(*keep, F.array(F.lit(1.0)).alias("posterior"))
        scored = _pinned(self.model.transform(features), keep, vector_to_array("scores"))
        weights = F.transform(F.array(F.col("pin_0")), lambda s: F.transform(s, lambda x: F.exp(self.softness * (x - F.array_max(s)))))[0]
        return scored.select(*keep, F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda t, y: t + y)))[0].alias("posterior"))

    def state(self, posterior: Column) -> Column:
        """(r, y): a document's rate after all steps, and where the next one starts."""
        if not self.steps:
            return F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        steps = F.array(*(F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(float(m)).alias("m")) for g, m in self.steps))

        def follow(state: Column, step: Column) -> Column:
            new = F.greatest(F.lit(0.0), state["y"] - _dot(posterior, step["g"]))
            return F.struct(new.alias("r"), (new + step["m"] * (new - state["r"])).alias("y"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), follow)


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, flatten: float = 0.5, softness: float = 0.25, most_steps: int = 32, tolerance: float = 1e-3) -> Mixer:
    """Learns domains from ``labelled`` (doc_id, domain) and finds the rates of ``docs`` (doc_id, text).

    ``targets`` are relative weights of the domains in expected tokens; without them each domain's share of the labelled tokens is raised to ``flatten``.
    The total stays that of all documents at rate 1. ``softness`` scales the log posteriors, as features aren't independent.
    Labels without id or domain, and those of unknown documents, are ignored; an id with several domains, or several texts, counts for each. Domains of targets that
    nothing is labelled with are left out. Without any labelled document there is one domain "all", and every rate is 1. Null and
    empty texts have no tokens. Steps end when every domain is within ``tolerance`` of its target, or after ``most_steps``.
    """
    spark = docs.sparkSession
    base = scratch(spark, "mixing")
    rows = written(text_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), f"{base}/features")
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null").distinct()
    stats = rows.join(known, "doc_id").groupBy("domain").agg(F.sum("n_tokens").alias("tokens")).orderBy("domain").collect()
    if targets is not None:
        stats = [r for r in stats if targets.get(r["domain"], 0) > 0]
    domains, model, weight = [r["domain"] for r in stats] or ["all"], None, np.ones(1)
    if stats:
        weight = np.array([targets[r["domain"]] if targets is not None else max(r["tokens"], 1) ** flatten for r in stats], float)
    if len(domains) > 1:
        taught = rows.join(known, "doc_id").select("f", (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("double").alias("label")).where("label >= 0")
        model = NaiveBayes(featuresCol="f", labelCol="label", smoothing=0.1).fit(taught)
        model = model.setPredictionCol("").setProbabilityCol("").setRawPredictionCol("scores")
    mixer = Mixer(domains, model, softness)
    k = len(mixer.domains)
    scored = written(mixer.posteriors(rows, ["doc_id", "n_tokens", "draw"]), f"{base}/posteriors")
    state = scored.where("n_tokens > 0").withColumnRenamed("posterior", "p")

    def totals() -> tuple[np.ndarray, np.ndarray]:
        now = state.select("n_tokens", "p", mixer.state(F.col("p")).alias("s"))
        got = now.agg(*(F.sum(F.col("n_tokens") * F.col("s")[x] * F.col("p")[i]) for x in "ry" for i in range(k))).first()
        a = np.array([x or 0.0 for x in got])
        return a[:k], a[k:]

    # A row of products for each domain: as many sums as domains, not their square.
    gram = np.zeros((k, k))
    product = lambda j: F.sum(F.col("n_tokens") * F.col("v") * F.col("p")[j])
    for r in state.select("n_tokens", "p", F.posexplode("p").alias("i", "v")).groupBy("i").agg(F.array(*map(product, range(k))).alias("row")).collect():
        gram[r["i"]] = r["row"]
    mass = gram.sum(1)
    total = mass.sum()
    weight = np.where(mass > 1e-9 * max(total, 1), weight, 0)
    want = total * weight / max(weight.sum(), 1e-300)
    # Whitened residuals: in these units the gradient's Lipschitz constant is below one, so steps have length one.
    metric = np.linalg.pinv(gram + 1e-3 * np.diag(mass) + 1e-12 * max(total, 1) * np.eye(k))
    reached = at_y = mass
    for step in range(most_steps):
        if total == 0 or (np.abs(reached - want) <= tolerance * np.maximum(want, 1e-9 * total)).all():
            break
        mixer.steps.append(((metric @ (at_y - want)).tolist(), step / (step + 3)))
        reached, at_y = totals()
    mixer.rows, mixer.targets, mixer.mass, mixer.reached = scored, want.tolist(), mass.tolist(), reached.tolist()
    return mixer


def document_rates(mixer: Mixer) -> DataFrame:
    """doc_id, n_tokens, posterior (array in the order of ``mixer.domains``), rate and copies of every fitted row, from the posteriors that the fit has stored.

    ``copies`` is the rate rounded down or up at random by a hash of doc_id and text, so that its expectation is the rate. A text without tokens has rate 1.
    """
    return _rates(mixer.rows, mixer, ["doc_id"])


def _pinned(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` and new columns as outputs of a generator of one row, which the optimizer neither repeats nor moves into later expressions."""
    names = [f"pin_{i}" for i in range(len(columns))]
    out = df.select(*keep, F.explode(F.array(F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True))))).alias("pin"))
    return out.select(*keep, *(F.col("pin")[n].alias(n) for n in names))


def _rates(df: DataFrame, mixer: Mixer, keep: list[str]) -> DataFrame:
    rate = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(mixer.state(F.col("posterior"))["r"])
    df = _pinned(df, [*keep, "n_tokens", "posterior", "draw"], rate).withColumnRenamed("pin_0", "rate").withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("long"))
    return df.select(*keep, "n_tokens", "posterior", "rate", "copies")


def mixed(docs: DataFrame, mixer: Mixer) -> DataFrame:
    """``docs`` with every row as often as its ``copies`` say, in the same columns, whatever they are called.

    A row's rate follows from its own text, so nothing is joined and repeated or null ids do no harm.
    """
    kept = [f"kept_{i}" for i in range(len(docs.columns))]
    named = docs.select(*(F.col(c).alias(x) for x, c in zip(kept, docs.columns, strict=True)), F.col("doc_id"), F.col("text"))
    scored = mixer.posteriors(text_features(named, kept), [*kept, "n_tokens", "draw"])
    rows = _rates(scored, mixer, kept).where("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*(F.col(x).alias(c) for x, c in zip(kept, docs.columns, strict=True)))
