"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words and word beginnings. Besides its loss on labelled documents it pays for every change of
score that comes from swapping identity terms in their sentences ("women" for "men", and so on), so a neutral mention
of a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import binary_texts, prefix_hashes, small_batches

#: Terms of one group stand for each other; each is swapped for the next one.
IDENTITY_GROUPS = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"), ("he", "she"), ("his", "her"), ("father", "mother"), ("son", "daughter"),
    ("muslim", "christian", "jew", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("islam", "christianity", "judaism", "hinduism", "buddhism", "atheism"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("old", "young"), ("disabled", "abled"),
    ("homme", "femme"), ("hommes", "femmes"), ("mann", "frau"), ("männer", "frauen"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")
#: Word beginnings of so many bytes are features besides whole words.
PREFIXES = (None, 4, 5, 6, 8)
_MARKS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def swap_identity(text: str) -> str:
    """The text with every identity term replaced by the next of its group."""
    return _WORD.sub(lambda m: SWAP.get(m[0].lower(), m[0]), text)


def feature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct feature hashes of each whole text; ASCII marks separate words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for k, h, of in prefix_hashes([t.translate(_MARKS) for t in texts], PREFIXES):
        if len(of):
            first, last = of[0], of[-1]
            for i, x in enumerate(np.split(h ^ _salt(k), np.searchsorted(of, np.arange(first + 1, last + 1))), first):
                out[i].append(x)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def _salt(k: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, weights: np.ndarray, bias: float) -> ToxicityModel:
        table = np.zeros(1 << 16, bool)
        table[hashes >> np.uint64(48)] = True
        return cls(hashes, weights, bias, table)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; each known feature counts once a text."""
        clean = [t.translate(_MARKS) for t in texts]
        n = max(1, len(self.hashes))
        found = [np.zeros(0, np.int64)]
        for k, h, of in prefix_hashes(clean, PREFIXES):
            h = h ^ _salt(k)
            maybe = np.flatnonzero(self.table[h >> np.uint64(48)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), n - 1)
                hit = self.hashes[at] == h[maybe]
                found.append(np.unique(of[maybe[hit]] * n + at[hit]))
        keys = np.unique(np.concatenate(found))
        z = self.bias + np.bincount(keys // n, self.weights[keys % n] if len(keys) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, delta: np.ndarray, fairness: float, l2: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weighted logistic loss + fairness * mean((delta w)^2) + l2 |w|^2 / 2, by accelerated gradient descent."""
    x, y, weight = x.astype(np.float32), y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(max((weight * y).sum(), 1e-6) / max((weight * (1 - y)).sum(), 1e-6)))
    delta, push = delta.astype(np.float32), np.float32(2 * fairness / max(1, len(delta)))

    def largest(product, n: int) -> float:
        v = np.ones(n, np.float32) / np.float32(np.sqrt(max(n, 1)))
        for _ in range(20):
            u = product(v)
            v = u / max(np.linalg.norm(u), 1e-12)
        return float(np.linalg.norm(product(v)))

    if x.shape[1]:
        rate = np.float32(1) / np.float32(1.1 * largest(lambda v: x.T @ (weight * (x @ v)) / 4 + push * (delta.T @ (delta @ v)), x.shape[1]) + 0.25 + l2)
        look, look_b = w, b
        for k in range(steps):
            g = weight * (1 / (1 + np.exp(-np.clip(x @ look + look_b, -40, 40))) - y)
            w1, b1 = look - rate * (x.T @ g + push * (delta.T @ (delta @ look)) + l2 * look), look_b - rate * g.sum()
            m = np.float32(k / (k + 3))
            look, look_b = w1 + m * (w1 - w), b1 + m * (b1 - b)
            w, b = w1, b1
    return w.astype(np.float64), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 8000, n_features: int = 2048, least_z: float = 5.0, fairness: float = 1.0, l2: float = 2e-5) -> ToxicityModel:
    """Learns ``labels.toxic`` (0, 1) from the texts of ``docs``; further columns are ignored.

    At most ``sample_docs`` labelled documents are learnt from, half of them toxic where there are so many, chosen by a hash of (doc_id, text); whole texts,
    never parts; repeated rows count once. Of all words and word beginnings in them, up to ``n_features`` whose share among toxic documents exceeds that among the others
    by ``least_z`` standard errors are features. Classes weigh as often as they occur among the labels. Rows with a null id
    or label are ignored, an id with several labels counts as toxic if one of them says so. With one class only, or none, every score is the
    share of toxic labels, 0 without any, and that holds for empty tables too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 0.0
    constant = ToxicityModel.of(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if len(count) < 2:
        return constant
    half = sample_docs // 2
    # Rows are chosen by their hash, so an id with many texts, or a text that is repeated, counts once each and the sample keeps its bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("h", F.xxhash64("id", "text"))
    marked = rows.select("id", "h").join(known, "id").select("y", "h").distinct()
    chosen = [marked.where(f"y = {y}").orderBy("h").limit(half if count[1 - y] > half else sample_docs - min(half, count[1 - y])) for y in (0, 1)]
    # At most sample_docs rows of 12 bytes: small by their limit.
    texts = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "h").groupBy("h").agg(F.first("y").alias("y"), F.first("text").alias("text")).select("y", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            sets = feature_sets(binary_texts(b.column(1)))
            if sets:
                v, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                toxic = np.bincount(inverse, np.repeat(y, [len(s) for s in sets]), len(v)).astype(np.int64)
                seen = np.bincount(inverse, minlength=len(v))
                at = np.flatnonzero(toxic)
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(toxic[at]), pa.array(seen[at] - toxic[at])], names=["feature", "t", "c"])
                at = np.flatnonzero(toxic == 0)
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(toxic[at]), pa.array(seen[at])], names=["feature", "t", "c"])

    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return constant
    n1, n0 = size[1], size[0]
    pooled = (F.col("t") + F.col("c")) / (n1 + n0)
    z = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    tallied = texts.mapInArrow(tally, "feature long, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = tallied.where("t >= 3").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(n_features).select("feature").toArrow()
    hashes = np.sort(best.column(0).to_numpy().view(np.uint64))
    if not len(hashes):
        return constant

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(raw: list[bytes]) -> list[bytes]:
            return [np.flatnonzero(np.isin(hashes, s)).astype(np.uint16).tobytes() for s in feature_sets(raw)]

        for b in batches:
            raw = binary_texts(b.column(1))
            swapped = [swap_identity(t.decode("utf-8", "replace")).encode("utf-8", "replace") for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places(raw), pa.binary()), pa.array(places(swapped), pa.binary())], names=["y", "x", "swapped"])

    sample = texts.mapInArrow(rows, "y int, x binary, swapped binary").toArrow()
    y = sample.column(0).to_numpy().astype(float)

    def dense(column: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(y), len(hashes)), np.float32)
        for i, r in enumerate(column.to_pylist()):
            out[i, np.frombuffer(r, np.uint16)] = 1
        return out

    x = dense(sample.column(1))
    delta = dense(sample.column(2)) - x
    delta = delta[np.abs(delta).any(1)]
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    w, bias = _fit(x, y, weight, delta, fairness, l2)
    return ToxicityModel.of(hashes, w, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text alone; null counts as empty, and empty texts get the score without any feature.

    Rows stand for themselves: ids may be null or repeated, repeated texts score alike. Further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(binary_texts(b.column(1))))], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents whose score is ``threshold`` or more, in one pass that hands all columns through, whatever they are called.

    Every row is judged by its own text; null counts as empty. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(binary_texts(b.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: Column) -> Column:
    """True for the ids that are never learnt from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4 == 2
