"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; a binary classifier of byte n-grams predicts each bit. A text's language is the
one whose codeword is nearest in logistic loss, each bit weighing by how reliable it was in training.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import small_batches

BUCKETS, ORDERS = 1 << 13, (2, 3, 4)
UNKNOWN = "und"
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is alphabetic; superscript digits and the like aren't."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def _size(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams in each lower-cased whole text, a row of unit length for each."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        data = b" " + t.lower().encode("utf-8", "replace") + b" "
        for lo in range(0, len(data), 4 << 20):  # with the overlap that n-grams need, so none is lost or counted twice
            a = np.frombuffer(data[lo : lo + (4 << 20) + max(ORDERS) - 1], np.uint8).astype(np.uint32)
            for n in ORDERS:
                m = min(len(a) - n + 1, 4 << 20)
                if m <= 0:
                    continue
                h = np.full(m, n * 2654435769 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ a[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                out[i] += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)
        out[i] = np.sqrt(out[i])
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits in two for up to five languages, else the best of 200 random codes by least distance."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        splits = np.arange(1 << (n - 1), (1 << n) - 1)
        return (((splits[None, :] >> np.arange(n - 1, -1, -1)[:, None]) & 1) * 2 - 1).astype(np.float32)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1.0, None)
    for _ in range(200):
        code = rng.permuted(np.tile(np.where(np.arange(n) % 2, 1, -1)[:, None], bits), axis=0)
        near = (bits - (code @ code.T - 2 * bits * np.eye(n))).min() / 2
        if near > best[0]:
            best = near, code
    return best[1].astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    #: Least text size in bytes of each limit, ascending, and the limits of the loss a bit; without sizes there is no limit.
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Languages that had enough labelled rows to check a limit on.
    checked: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword; log(1 + exp(m)) = log(1 + exp(-m)) + m makes it one matrix product."""
        margin = (x @ self.weights).astype(np.float64)
        return (np.logaddexp(0, -margin) @ self.trust)[:, None] + (margin * self.trust) @ (0.5 - self.code.T / 2)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """Soft nearness of each codeword: softmax of the negative weighted loss."""
        return _softmax(self.losses(x))

    def loss_a_bit(self, losses: np.ndarray) -> np.ndarray:
        """The nearest codeword's loss divided by the weight of all bits; log 2 is a coin flip for each. 0 where there are no bits."""
        return losses.min(1) / max(float(self.trust.sum()), 1e-12)

    def fits(self, loss: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Whether texts of ``size`` bytes lie as near to their language as labelled rows of that size or more do."""
        if not len(self.sizes):
            return np.ones(len(loss), bool)
        at = np.clip(np.searchsorted(self.sizes, size, side="right") - 1, 0, None)
        return (loss <= self.limits[at]) | ~self.checked[chosen]


def _softmax(losses: np.ndarray) -> np.ndarray:
    near = np.exp(losses.min(1, keepdims=True) - losses)
    return near / near.sum(1, keepdims=True)


#: Rows of a language, and of a range of sizes, that a limit needs.
LEAST_CHECKED, LEAST_SIZES = 20, 200


def _limits(loss: np.ndarray, size: np.ndarray, right: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, limits and checked languages from the losses a bit of rows that were not learnt from, so that all rightly decoded ones stay.

    A limit lies half-way between log 2, the loss of coin flips, and the largest loss of the rows of at least its size, or of the LEAST_SIZES longest:
    short texts tell less, so more is allowed for them.
    """
    checked = np.bincount(y[right], minlength=n) >= LEAST_CHECKED
    use = right & checked[y]
    order = np.argsort(size[use], kind="stable")
    top = np.maximum.accumulate(loss[use][order][::-1])[::-1]
    top[-LEAST_SIZES:] = top[-LEAST_SIZES:].max(initial=0)
    sizes, first = np.unique(size[use][order], return_index=True)
    return sizes, np.minimum((top[first] + np.log(2)) / 2, np.log(2)), checked


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """One logistic regression for each column of y (+1, -1) by accelerated gradient descent; without a constant, so unknown n-grams are coin flips."""
    n = len(x)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    look, rate = w, 4.0 / (1.3 + 4 * l2)
    for k in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ look), -30, 30))) / n
        w1 = look - rate * (x.T @ g + l2 * look)
        look, w = w1 + k / (k + 3) * (w1 - w), w1
    return w


#: Parts of the sample that are decoded by models of the other parts; documents that each language has in the sample, if it has them.
FOLDS, LEAST_DOCS = 5, 8


def _sample(docs: DataFrame, sample_docs: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All languages; and language, features and bytes of the sampled texts: of each language those with the least hashes of (doc_id, text), each once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id")).where("lang is not null and text is not null and length(text) > 0")
    rows = rows.select("lang", "text", F.xxhash64("id", "text", F.lit(11)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64)
    share = max(sample_docs // len(languages), LEAST_DOCS)
    # Half as many again are drawn, since the counts are estimates; the exact cut follows.
    rates = docs.sparkSession.createDataFrame([(x, i, min(1.0, 1.5 * (share + 20) / max(counts[x], 1))) for i, x in enumerate(languages)], "lang string, y int, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            y, h, text = (c.to_pylist() for c in b.columns)
            keep = []
            for i, key in enumerate(zip(y, h, strict=True)):
                if key not in seen:
                    seen.add(key)
                    if has_letter(text[i]):
                        keep.append(i)
            x = features([text[i] for i in keep]).astype(np.float16)
            packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in x]
            columns = [pa.array([y[i] for i in keep], pa.int32()), pa.array([h[i] for i in keep], pa.int64()), pa.array(packed, pa.binary()), pa.array([_size(text[i]) for i in keep], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "h", "x", "size"])

    found = drawn.select("y", "h", "text").mapInArrow(run, "y int, h long, x binary, size long").dropDuplicates(["y", "h"]).toArrow()
    y, h = found.column("y").to_numpy(), found.column("h").to_numpy()
    order = np.lexsort((h, h & ((1 << 30) - 1), y))
    rank = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    order = order[rank < share]
    packed = found.column("x").take(pa.array(order)).to_pylist()
    x = np.zeros((len(order), BUCKETS), np.float32)
    for i, r in enumerate(packed):
        k = len(r) // 4
        x[i, np.frombuffer(r[: 2 * k], np.uint16)] = np.frombuffer(r[2 * k :], np.float16)
    return languages, y[order], x, found.column("size").to_numpy()[order]


def fit_languages(docs: DataFrame, sample_docs: int = 2400, l2: float = 1e-5, steps: int = 150) -> LanguageModel:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with text and lang.

    At most ``sample_docs`` documents are used, or LEAST_DOCS of each language if that is more; as many of each language where it has them, those with
    the least hashes of (doc_id, text); whole texts, never parts. Without labelled rows no language is known and every text is ``und``; with one language
    all texts with letters are of it.
    """
    languages, y, x, size = _sample(docs, sample_docs)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    code = codewords(len(languages))
    if not len(y) or not code.shape[1]:
        return LanguageModel(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32))
    # Each fifth of the sample is decoded by what the others taught; that measures how far each bit is to be trusted, and which losses occur.
    target, fold = code[y], np.arange(len(y)) % FOLDS
    margin = np.zeros(target.shape)
    for k in range(FOLDS if len(y) > 1 else 0):
        aside = fold == k
        if aside.any():
            margin[aside] = x[aside] @ _logistic(x[~aside], target[~aside], l2, steps // 2)
    right = ((margin * target > 0).sum(0) + 1) / (len(y) + 2)
    trust = np.log(np.maximum(right / (1 - right), 1.01)).astype(np.float32)
    model = LanguageModel(languages, code, _logistic(x, target, l2, steps), (trust / trust.mean()).astype(np.float32))
    decoded = LanguageModel(languages, code, np.eye(code.shape[1]), model.trust).losses(margin)
    model.sizes, model.limits, model.checked = _limits(model.loss_a_bit(decoded), size, decoded.argmin(1) == y, y, len(languages))
    return model


def _decide(model: LanguageModel, text: list[str], close: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, whether ambiguous and whether it fits, for each text."""
    lang, score, ambiguous, fits = [UNKNOWN] * len(text), np.zeros(len(text)), np.ones(len(text), bool), np.zeros(len(text), bool)
    for lo in range(0, len(text), 128):
        keep = [i for i in range(lo, min(lo + 128, len(text))) if model.languages and has_letter(text[i])]
        if keep:
            losses = model.losses(features([text[i] for i in keep]))
            p, loss = _softmax(losses), model.loss_a_bit(losses)
            order = np.argsort(losses, 1, kind="stable")
            fits[keep] = model.fits(loss, np.array([_size(text[i]) for i in keep]), order[:, 0])
            for i, row, o, x in zip(keep, p, order, loss, strict=True):
                lang[i], score[i] = model.languages[o[0]], min(1.0, float(row[o[0]])) * max(0.0, 1 - x / np.log(2))
                ambiguous[i] = len(o) > 1 and row[o[0]] - row[o[1]] < close
    return lang, score, ambiguous, fits


def _predict(model: LanguageModel, close: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, ambiguous, _ = _decide(model, [t or "" for t in b.column(1).to_pylist()], close)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: LanguageModel, close: float = 0.2, keys: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for every row, from the whole text alone.

    score is the soft nearness of the chosen codeword times what its loss a bit leaves of log 2, 0 to 1; a lead in nearness below ``close``
    over the next codeword is ambiguous. Null texts and
    those without a letter are ``und`` with score 0, and ambiguous. ``keys`` replaces doc_id in the result. Of codewords equally near the language that
    comes first by name is chosen. Each row gives one row, repeated rows and null ids too; an empty table gives an empty one; further columns are
    ignored, whatever they are called. Texts of any length are taken whole, in pieces whose features add up.
    """
    small_batches(docs.sparkSession)
    key = F.col("doc_id").cast("long") if keys is None else keys
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, close), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def filter_languages(docs: DataFrame, model: LanguageModel, least_score: float = 0.0) -> DataFrame:
    """``docs`` without the documents that are ``und``, don't fit their language, or score below ``least_score``; columns and kept rows are as they were.

    A document fits where its loss is within the limit that labelled rows of its size or more set. Where no language was learnt, all texts with letters stay.
    One pass that hands all columns through, so nothing is joined; repeated rows and null ids are treated row by row.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [t or "" for t in b.column(at).to_pylist()]
            if not model.languages:
                keep = [has_letter(t) for t in text]
            else:
                lang, score, _, fits = _decide(model, text, 0.0)
                keep = [x != UNKNOWN and f and s >= least_score for x, s, f in zip(lang, score, fits.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
