"""Importance resampling towards a target's n-grams: documents' bucket counts as bit planes meet signed bit planes of the gains, and popcounts times powers of two are the exact weights."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import batches_by_bytes, binary_texts, scratch, small_batches, written
from seqspark.operators.order import first_filter, ranked

#: Longest n-gram of words, and bytes up to which words are hashed in columns; longer words are hashed one by one.
ORDER, SHORT = 3, 64
#: Bytes of text that are hashed together. A longer text is cut between words, and n-grams across cuts are kept.
BLOCK = 1 << 20
#: Documents whose planes are in memory together.
ROWS = 64

# Bytes of words: digits, letters and all beyond ASCII.
WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD[_lo : _hi + 1] = False
WORD[0x41:0x5B] = True  # they are lower-cased
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_table() -> np.ndarray:
    """What a byte does to a crc32, by its reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[length, byte of the crc, its value]: a crc32 with ``length`` zero bytes behind, which is linear in the crc's bytes."""
    t = np.empty((SHORT + 2, 4, 256), np.uint32)
    t[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(t)):
        t[n] = _TABLE[t[n - 1] & np.uint32(255)] ^ (t[n - 1] >> np.uint32(8))
    return t


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each crc32 as it goes into that of a text with so many bytes behind: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out, left = crc, length
    while True:
        n = np.minimum(left, SHORT + 1)
        out = _SHIFT[n, 0, out & np.uint32(255)] ^ _SHIFT[n, 1, out >> np.uint32(8) & np.uint32(255)] ^ _SHIFT[n, 2, out >> np.uint32(16) & np.uint32(255)] ^ _SHIFT[n, 3, out >> np.uint32(24)]
        left = left - n
        if not left.any():
            return out


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each word, a column of bytes at a time; words over ``SHORT`` bytes one by one."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    short = order[np.searchsorted(-size[order], -SHORT) :]
    for i in order[: len(order) - len(short)]:
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    at, n = start[short], size[short]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for column in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -column))  # words longer than this column come first
        crc[:k] = _TABLE[(crc[:k] ^ data[at[:k] + column]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _block_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, crc32 of each feature, words of each text) of lower-cased texts in ``data`` that end before ``ends`` and are kept apart by a byte that is in no word."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], WORD[data], [False])).view(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    text = np.searchsorted(ends, start, side="right")
    words = np.bincount(text, minlength=len(ends))
    crc = word_crcs(data, start, size)
    spaced = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ crc
    texts, crcs, run = [text], [crc], crc
    for n in range(1, ORDER):
        run = shifted(run[:-1], size[n:] + 1) ^ spaced[n:] if len(size) > n else run[:0]
        whole = text[n:] == text[: max(len(text) - n, 0)]
        texts.append(text[n:][whole])
        crcs.append(run[whole])
    return np.concatenate(texts), np.concatenate(crcs), words


def _pieces(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A long text in parts of about ``BLOCK`` bytes that end between words, each with the words before it that n-grams reach back to."""
    lo, tail = 0, b""
    while lo < len(text):
        hi = min(lo + BLOCK, len(text))
        while hi < len(text) and WORD[text[hi]]:
            hi += 1
        yield tail, text[lo:hi]
        kept, cut = [], b""
        at = hi
        while at > lo and len(kept) < ORDER - 1:
            end = at
            while end > lo and not WORD[text[end - 1]]:
                end -= 1
            at = end
            while at > lo and WORD[text[at - 1]]:
                at -= 1
            if at < end:
                kept.append(text[at:end])
        cut = b" ".join(reversed(kept))
        tail = cut if len(kept) == ORDER - 1 else b" ".join(x for x in (*(tail.split(b" ")[len(kept) - ORDER + 1 :] if tail else ()), cut) if x)
        lo = hi


def bucket_counts(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For up to ``ROWS`` texts at a time: their counts of features in each bucket, and their words."""
    for first in range(0, len(texts), ROWS):
        some = texts[first : first + ROWS]
        counts, words = np.zeros((len(some), buckets), np.int64), np.zeros(len(some), np.int64)

        def add(group: list[bytes], rows: np.ndarray, sign: int, counts=counts, words=words) -> None:
            data = _LOWER[np.frombuffer(b" ".join(group), np.uint8)]
            of, crc, n = _block_features(data, np.cumsum([len(t) + 1 for t in group]))
            lo, hi = int(rows[0]), int(rows[-1]) + 1
            found = np.bincount((rows[of] - lo) * buckets + crc % np.uint32(buckets), minlength=(hi - lo) * buckets).reshape(hi - lo, buckets)
            counts[lo:hi] += sign * found
            np.add.at(words, rows, sign * n)

        for lo, hi in batches_by_bytes(some, BLOCK):
            if hi - lo == 1 and len(some[lo]) > BLOCK:
                for tail, part in _pieces(some[lo]):
                    add([tail + b" " + part], np.array([lo]), 1)
                    if tail:
                        add([tail], np.array([lo]), -1)
            else:
                add(some[lo:hi], np.arange(lo, hi), 1)
        yield counts, words


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of rows of nonnegative numbers, lowest first, each packed into 64-bit words."""
    wide = -values.shape[-1] % 64
    values = np.pad(values, [(0, 0)] * (values.ndim - 1) + [(0, wide)])
    return [np.packbits((values >> k & 1).astype(bool), axis=-1, bitorder="little").view("<u8") for k in range(int(values.max(initial=0)).bit_length())]


class GainPlanes:
    """Signed bit planes of the gains of all buckets."""

    def __init__(self, gains: np.ndarray):
        self.signed = [(s, _planes(np.maximum(s * gains.astype(np.int64), 0))) for s in (1, -1)]

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Sums of count times gain over the buckets of each row: popcounts of ANDed planes times powers of two.

        A plane of the counts holds only rows that reach it, so a document with a large count costs others nothing.
        """
        out = np.zeros(len(counts), np.int64)
        most = counts.max(1, initial=0)
        for j in range(int(most.max(initial=0)).bit_length()):
            rows = np.flatnonzero(most >> j)
            bits = np.packbits(np.pad((counts[rows] >> j & 1).astype(bool), ((0, 0), (0, -counts.shape[1] % 64))), axis=-1, bitorder="little").view("<u8")
            for sign, planes in self.signed:
                for k, plane in enumerate(planes):
                    out[rows] += sign * (np.bitwise_count(bits & plane).sum(1, dtype=np.int64) << (j + k))
        return out


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def bucket_totals(df: DataFrame, buckets: int) -> np.ndarray:
    """Features of all whole texts in each bucket: every task hands on its own totals, one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for counts, _ in bucket_counts(binary_texts(b.column(0)), buckets):
                total += counts.sum(0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in _texts(df).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed ratio of target to source shares, downwards."""
    s_all, t_all, m = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + m) / ((float(s) + 1) * (t_all + m)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every whole text; null and empty texts have none and weigh 0. Each row gives one row; other columns are dropped."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = GainPlanes(gains)
        for b in batches:
            lo = 0
            for counts, words in bucket_counts(binary_texts(b.column(1)), len(gains)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(words)), pa.array(words), pa.array(counts.sum(1)), pa.array(planes.weigh(counts))], names=["doc_id", "n_words", "n_features", "weight"])
                lo += len(words)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, key: str) -> Column:
    """Thousandths of a Gumbel variate of (seed, key), downwards."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text): those drawn towards the texts of ``target`` have a rank.

    Features are runs of one to three words, hashed into ``buckets``; a document's weight sums its features' gains, and its score adds Gumbel noise, so the
    best scores are a draw without replacement in proportion to the exponential of the weights. Of the documents with ``least_words`` or more
    a ``percent`` is drawn, downwards; ties go to the smaller id (null last). Rows with the same id and text have the same score,
    and any of those at the last place is drawn. Null texts have no words; an empty target or an empty table is fine. Counts cover all texts whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gains = bucket_gains(bucket_totals(docs, buckets), bucket_totals(target, buckets))
    base = scratch(spark, "importance")
    # A number of each row, stored with it, parts rows that are alike.
    weighed = importance_weights(docs, gains).withColumn("score", F.col("weight") + gumbel(seed, "doc_id")).withColumn("_row", F.monotonically_increasing_id())
    scored = written(weighed, f"{base}/scored")
    eligible, order = scored.where(F.col("n_words") >= least_words), (("score", False), ("doc_id", True), ("_row", True))
    best = first_filter(eligible, percent * eligible.count() // 100, *order)[0] & (F.col("n_words") >= least_words)
    drawn = ranked(scored.where(best), f"{base}/drawn", *order)
    return drawn.unionByName(scored.where(~best).withColumn("rank", F.lit(None).cast("long"))).drop("_row")
