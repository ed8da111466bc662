"""Scoring with an interpolated modified Kneser-Ney model of bigrams or trigrams.

Counting: each task turns texts into word hashes and hands on its distinct bigrams with counts, cut into buckets by the hash of
the first word. A first word that is so frequent that its followers would outgrow a bucket has them dealt over several, by the second
word. A reducing task merges a bucket and stores the bigrams as a sorted hash array with counts; of contexts that it alone has, it stores the totals and
numbers of followers seen once, twice and more often as well. What it knows of a part of a thing goes on to a second reduction, dealt by the word: the
parts of the frequent contexts, and how many distinct predecessors each word has in the bucket. That one stores the unigram arrays.
Scoring: workers map the arrays and look up the sorted distinct bigrams of a block of texts, bucket by bucket. A bucket's file has the bucket's number for
a name, so neither driver nor closures hold a table of them.
With an order of three, trigrams are counted and dealt by their second and third words just as bigrams are by their first and second: all that a bigram follows
meet in its bucket, where the number of distinct ones is the bigram's count. Contexts of two words are whole in one bucket, but where the second is
frequent; those of all such parts are added up in the second reduction, dealt by the context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import avalanche, batches_by_bytes, binary_texts, chain, discard, has_file, input_bytes, map_file, scratch, small_batches, word_hashes, write_file, written

#: Hashes of the marks before the first word and behind the last; no word's, but by an accident of 64 bits.
BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Tokens that a task counts before it hands on its bigrams; bytes of input for a bucket.
FLUSH, BUCKET_BYTES = 4_000_000, 6 << 20
#: One document of so many is looked at for frequent words, of which the first so many are dealt over several buckets. Both decide only where the work is done.
LAYOUT_SHARE, LAYOUT_WORDS = 64, 10_000


@dataclass
class Layout:
    """Which bucket has what: ranges of the first word's hash, and for frequent first words (sorted) ``spread`` buckets from there on, by the second word."""

    n: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def of_word(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) * np.uint64(self.n) >> np.uint64(24)).astype(np.int64)

    def hot_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the frequent ones among ``h``, and their places in ``hot``."""
        place, there = _find(self.hot, h)
        at = np.flatnonzero(there)
        return at, place[at]

    def of_pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        bucket = self.of_word(first)
        at, k = self.hot_words(first)
        if len(at):
            bucket[at] = (bucket[at] + (avalanche(second[at]) % self.spread[k]).astype(np.int64)) % self.n
        return bucket


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and whether each is there."""
    if not len(sorted_hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def _pairs(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of the bigrams of texts, marks included."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size + 1)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    second = np.full(int(size.sum()) + len(words), END, np.uint64)
    first = np.full(len(second), BEGIN, np.uint64)
    inner = np.ones(len(second), bool)
    inner[end - 1] = False
    second[inner] = flat
    begin = np.ones(len(second), bool)
    begin[end - size - 1] = False
    first[begin] = flat
    return first, second


def _before(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The words before the bigrams of :func:`_pairs`; two marks stand before a text's first word."""
    third = np.concatenate(([BEGIN], first[:-1]))[: len(first)]
    third[first == BEGIN] = BEGIN
    return third


def _merged(first: np.ndarray, second: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with summed counts."""
    vocabulary = np.unique(np.concatenate((first, second)))
    key = (np.searchsorted(vocabulary, first).astype(np.uint64) << np.uint64(32)) | np.searchsorted(vocabulary, second).astype(np.uint64)
    if count is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[start], np.add.reduceat(count[order], start) if len(start) else count
    return vocabulary[(key >> np.uint64(32)).astype(np.int64)], vocabulary[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], n.astype(np.int64)


def _merged_triples(before: np.ndarray, first: np.ndarray, second: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Distinct triples by (first, second, before): words before, their summed counts, distinct pairs of first and second, and how many triples each of these has."""
    vocabulary = np.unique(np.concatenate((before, first, second)))
    at = lambda x: np.searchsorted(vocabulary, x).astype(np.uint64)
    pair, of_pair = np.unique((at(first) << np.uint64(32)) | at(second), return_inverse=True)
    key = (of_pair.astype(np.uint64) << np.uint64(32)) | at(before)
    if count is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[start], np.add.reduceat(count[order], start) if len(start) else count
    kinds = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(pair))
    word = lambda x: vocabulary[x.astype(np.int64)]
    low = np.uint64(0xFFFFFFFF)
    return word(key & low), n.astype(np.int64), word(pair >> np.uint64(32)), word(pair & low), kinds


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of what is in it, in their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(b[lo]), order[lo:hi]


def _packed(count: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, 255 standing for the next of the 64-bit ones."""
    return np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype(np.int64).tobytes()


def _unpacked(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _numbers(x: np.ndarray, size: int) -> bytes:
    """Places below ``size``, in two bytes each where that is enough."""
    return x.astype(np.uint16 if size <= 1 << 16 else np.uint32).tobytes()


_COUNTED = "bucket int, contexts binary, followers binary, second binary, small binary, large binary"
#: The same for trigrams: the words of a bucket once, and places among them.
_COUNTED_TRIPLES = "bucket int, words binary, first binary, second binary, few binary, many binary, before binary, small binary, large binary"


def _binary_row(names: str, row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=[x.split()[0] for x in names.split(", ")])


def _counter(layout: Layout, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush_triples(held: list) -> Iterator[pa.RecordBatch]:
            first, second = np.concatenate([f for f, _ in held]), np.concatenate([s for _, s in held])
            before, count, first, second, kinds = _merged_triples(_before(first, second), first, second, None)
            start = np.cumsum(kinds) - kinds
            for bucket, at in _slices(layout.of_pair(first, second)):
                k = kinds[at]
                inside = np.repeat(start[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                b, n = before[inside], count[inside]
                words = np.unique(np.concatenate((first[at], second[at], b)))
                numbers = lambda x: _numbers(np.searchsorted(words, x), len(words))  # noqa: B023, E731
                yield _binary_row(_COUNTED_TRIPLES, [bucket, words.tobytes(), numbers(first[at]), numbers(second[at]), *_packed(k), numbers(b), *_packed(n)])

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            if order == 3:
                yield from flush_triples(held)
                return
            first, second, count = _merged(np.concatenate([f for f, _ in held]), np.concatenate([s for _, s in held]), None)
            for bucket, at in _slices(layout.of_pair(first, second)):
                f = first[at]
                start = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                small, large = _packed(count[at])
                yield _binary_row(_COUNTED, [bucket, f[start].tobytes(), np.diff(start, append=len(f)).astype(np.uint32).tobytes(), second[at].tobytes(), small, large])

        held, size = [], 0
        for b in batches:
            texts = binary_texts(b.column(0))
            for lo, hi in batches_by_bytes(texts):
                held.append(_pairs(word_hashes(texts[lo:hi])))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _file(*arrays: np.ndarray) -> list[bytes]:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return [head.tobytes(), *(x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]


def _arrays(uri: str, kinds: tuple) -> list[np.ndarray]:
    data = map_file(uri)
    n = int(data[:8].view(np.int64)[0])
    sizes, at, out = data[8 : 8 * (n + 1)].view(np.int64), 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        nbytes = int(size) * np.dtype(kind).itemsize
        out.append(data[at : at + nbytes].view(kind))
        at += nbytes + (-nbytes % 8)
    return out


def _dense(count: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and places and values of those from 255 on."""
    large = np.flatnonzero(count >= 255)
    return [np.minimum(count, 255).astype(np.uint8), large, count[large].astype(np.int64)]


def _taken(small: np.ndarray, large_at: np.ndarray, large: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Counts stored by :func:`_dense`, at some places."""
    out = small[place].astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = large[np.searchsorted(large_at, place[big])]
    return out


_DENSE = (np.uint8, np.int64, np.int64)
#: Bigram files: sorted hashes, counts; contexts, totals, followers seen once, twice, more often, occurrences in the text.
_BIGRAMS = (np.uint64, *_DENSE, np.uint64, *_DENSE * 5)
#: Unigram files: sorted hashes and distinct predecessors; frequent contexts with the same five numbers as above.
_UNIGRAMS = (np.uint64, *_DENSE, np.uint64, *_DENSE * 5)
#: Files of contexts of two words: sorted hashes, totals, followers seen once, twice, more often. Trigram files: sorted hashes, counts, and the same.
_CONTEXTS = (np.uint64, *_DENSE * 4)
_TRIGRAMS = (np.uint64, *_DENSE, *_CONTEXTS)
_SUMS = ["n", "once", "twice", "thrice", "often", "tokens", "begins"]
_PART = f"kind string, bucket int, {', '.join(f'{c} long' for c in _SUMS)}, words binary, small binary, large binary"


def _row(kind: str, bucket: int, count: np.ndarray, tokens: int = 0, begins: int = 0, words: bytes | None = None, small: bytes | None = None, large: bytes | None = None) -> dict:
    kinds = [int((count == k).sum()) for k in (1, 2, 3, 4)]
    return dict(zip(["kind", "bucket", *_SUMS, "words", "small", "large"], [kind, bucket, len(count), *kinds, tokens, begins, words, small, large], strict=True))


def _by_context(first: np.ndarray, count: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts of n-grams sorted by them, each with its total, the numbers of followers seen once, twice and more often, and sums of ``more``."""
    start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return first[start], [add(x) for x in (count, count == 1, count == 2, count >= 3, *more)]


def _triples(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Words before, first and second words and counts of a bucket's trigrams, as tasks counted them."""
    out = []
    for r in rows.itertuples():
        words = np.frombuffer(r.words, np.uint64)
        place = lambda x: words[np.frombuffer(x, np.uint16 if len(words) <= 1 << 16 else np.uint32)]  # noqa: B023, E731
        kinds = _unpacked(r.few, r.many)
        out.append((place(r.before), np.repeat(place(r.first), kinds), np.repeat(place(r.second), kinds), _unpacked(r.small, r.large)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _reducer(folder: str, layout: Layout, order: int) -> Callable:
    def store_triples(bucket: int, rows: pd.DataFrame) -> tuple[list[dict], tuple[np.ndarray, ...]]:
        before, n, first, second, kinds = _merged_triples(*_triples(rows))
        of_pair = np.repeat(np.arange(len(first)), kinds)
        context = chain(before, first[of_pair])
        hashes = chain(context, second[of_pair])
        at = np.argsort(hashes)
        by = np.argsort(context)
        contexts, stats = _by_context(context[by], n[by])
        _, frequent = _find(layout.hot, first[of_pair][by][np.searchsorted(context[by], contexts)])
        own = ~frequent
        write_file(folder, f"trigrams-{bucket}", _file(hashes[at], *_dense(n[at]), contexts[own], *(y for x in stats for y in _dense(x[own]))), final=True)
        out = [_row("trigrams", bucket, n, int(n.sum()), int(n[(first == BEGIN)[of_pair]].sum()))]
        for other, k in _slices(layout.of_word(contexts[frequent])):
            k = np.flatnonzero(frequent)[k]
            out.append(_row("pairs", other, n[:0], 0, 0, contexts[k].tobytes(), *_packed(np.concatenate([x[k] for x in stats]))))
        raw = np.add.reduceat(n, np.cumsum(kinds) - kinds) if len(kinds) else n
        return out, (first, second, kinds.astype(np.int64), raw)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if order == 3:
            more, (first, second, count, raw) = store_triples(key[0], rows)
            return bigrams(key, first, second, count, raw, more)
        first = np.concatenate([np.repeat(np.frombuffer(c, np.uint64), np.frombuffer(f, np.uint32)) for c, f in zip(rows["contexts"], rows["followers"], strict=True)])
        second = np.concatenate([np.frombuffer(s, np.uint64) for s in rows["second"]])
        count = np.concatenate([_unpacked(s, x) for s, x in zip(rows["small"], rows["large"], strict=True)])
        first, second, count = _merged(first, second, count)
        return bigrams(key, first, second, count, count, [])

    def bigrams(key: tuple, first: np.ndarray, second: np.ndarray, count: np.ndarray, raw: np.ndarray, out: list[dict]) -> pd.DataFrame:
        hashes = chain(first, second)
        by = np.argsort(hashes)
        contexts, stats = _by_context(first, count, raw)
        _, there = _find(layout.hot, contexts)
        own = ~there
        write_file(folder, f"bigrams-{key[0]}", _file(hashes[by], *_dense(count[by]), contexts[own], *(y for x in stats for y in _dense(x[own]))), final=True)
        out.append(_row("bigrams", key[0], count, int(raw.sum()), int(raw[first == BEGIN].sum())))
        for bucket, at in _slices(layout.of_word(contexts[there])):
            k = np.flatnonzero(there)[at]
            out.append(_row("contexts", bucket, count[:0], words=contexts[k].tobytes(), large=np.stack([x[k] for x in stats]).tobytes()))
        # Distinct predecessors of each word in this bucket.
        words, before = np.unique(second, return_counts=True)
        for bucket, at in _slices(layout.of_word(words)):
            out.append(_row("before", bucket, count[:0], 0, 0, words[at].tobytes(), *_packed(before[at])))
        return pd.DataFrame(out)

    return run


def _each_bucket(rows: DataFrame, n: int, reduce: Callable) -> DataFrame:
    """``reduce`` of every bucket, each in a partition of its own: a bucket's number is its partition's, so no two meet by chance of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = reduce((held[0].column(at)[0].as_py(),), pa.Table.from_batches(held).to_pandas())
            return pa.RecordBatch.from_pandas(table, schema=_PART_ARROW, preserve_index=False)

        for b in batches:
            at = b.schema.get_field_index("bucket")
            buckets = b.column(at).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi > lo:
                    if held and held[0].column(at)[0].as_py() != int(buckets[lo]):
                        yield done()
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PART)


_PART_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _PART.split(", "))])


def _unigrams(folder: str) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        some = rows[rows["kind"] == "before"]
        words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(w, np.uint64) for w in some["words"])])
        before = np.concatenate([np.zeros(0, np.int64), *(_unpacked(s, x) for s, x in zip(some["small"], some["large"], strict=True))])
        words, inverse = np.unique(words, return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, inverse, before)
        parts = rows[rows["kind"] == "contexts"]
        contexts, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(w, np.uint64) for w in parts["words"])]), return_inverse=True)
        stats = np.zeros((5, len(contexts)), np.int64)
        for x, of_stat in zip(stats, np.concatenate([np.zeros((5, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(5, -1) for x in parts["large"])], axis=1), strict=True):
            np.add.at(x, of, of_stat)
        pairs = rows[rows["kind"] == "pairs"]
        if len(pairs):
            two, of = np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in pairs["words"]]), return_inverse=True)
            sums = np.concatenate([_unpacked(s, x).reshape(4, -1) for s, x in zip(pairs["small"], pairs["large"], strict=True)], axis=1)
            added = [np.bincount(of, x, minlength=len(two)).astype(np.int64) for x in sums]
            write_file(folder, f"contexts-{key[0]}", _file(two, *(y for x in added for y in _dense(x))), final=True)
        write_file(folder, f"unigrams-{key[0]}", _file(words, *_dense(total), contexts, *(y for x in stats for y in _dense(x))), final=True)
        return pd.DataFrame([_row("unigrams", key[0], total, int(total.sum()))])

    return run


def _discounts(once: int, twice: int, thrice: int, often: int) -> np.ndarray:
    """Chen and Goodman's discounts for counts 0 (none), 1, 2 and 3 or more; where a needed count of counts is zero, 0.5, 1 and 1.5."""
    if not once or not twice or not thrice:
        return np.array([0, 0.5, 1.0, 1.5])
    y = once / (once + 2 * twice)
    return np.array([0, *np.clip([1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * often / thrice], 0.01, [0.99, 1.99, 2.99])])


@dataclass
class KneserNey:
    """Where a model's arrays are, and its scalars. ``tokens`` and ``vocabulary`` count words and end marks; ``top`` are trigrams' discounts, None without them."""

    folder: str
    layout: Layout
    high: np.ndarray
    low: np.ndarray
    low_total: int
    low_kinds: tuple[int, int, int]
    tokens: int
    vocabulary: int
    documents: int
    top: np.ndarray | None = None


def _layout(texts: DataFrame, n: int) -> Layout:
    """Frequent words from one text of LAYOUT_SHARE: those with over half of a bucket's share of all words, LAYOUT_WORDS at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, _ = _pairs(word_hashes(binary_texts(b.column(0))))
            words, count = np.unique(first, return_counts=True)
            at = np.flatnonzero(count * 4 * n >= len(first))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[at], BEGIN).view(np.int64)), pa.array(np.append(count[at], 0)), pa.array(np.append(np.zeros(len(at), np.int64), len(first)))], names=["word", "n", "tokens"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(LAYOUT_SHARE)) == 0).mapInArrow(tally, "word long, n long, tokens long")
    top = some.groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), F.desc("n"), "word").limit(LAYOUT_WORDS).toPandas()
    share = top["n"].to_numpy(float) / max(int(top["tokens"].sum()), 1)
    hot = share * n > 0.5
    words, spread = top["word"].to_numpy(np.int64)[hot].view(np.uint64), np.minimum(np.ceil(2 * share[hot] * n) + 1, n)
    order = np.argsort(words)
    return Layout(n, words[order], spread[order].astype(np.uint64))


def count_ngrams(docs: DataFrame, order: int = 2) -> KneserNey:
    """Counts all whole texts of ``docs`` (null: empty, that is one end mark) and stores the model's arrays in the shared folder, for an order of two or three.

    Only sums come to the driver, and the layout's frequent words. Repeated rows count each time, ids and further columns are ignored. An empty table gives a model without any n-gram.
    """
    if order not in (2, 3):
        raise ValueError("order is two or three")
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "kn")
    n_buckets = int(max(8, input_bytes(docs) // BUCKET_BYTES))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    layout = _layout(texts, n_buckets)
    parts = written(_each_bucket(texts.mapInArrow(_counter(layout, order), _COUNTED_TRIPLES if order == 3 else _COUNTED), n_buckets, _reducer(f"{folder}/arrays", layout, order)), f"{folder}/counted")
    lower = _each_bucket(parts.where("kind not in ('bigrams', 'trigrams')"), n_buckets, _unigrams(f"{folder}/arrays"))
    total = lambda df: df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS)).first()
    high, low = total(parts.where("kind = 'bigrams'")), total(written(lower, f"{folder}/lower"))
    top = total(parts.where("kind = 'trigrams'")) if order == 3 else None
    discard(spark, f"{folder}/counted")
    discount = lambda s: _discounts(s["once"], s["twice"], s["thrice"], s["often"])
    kinds = (low["once"], low["twice"], low["n"] - low["once"] - low["twice"])
    return KneserNey(f"{folder}/arrays", layout, discount(high), discount(low), low["tokens"], kinds, high["tokens"], low["n"], high["begins"], discount(top) if top else None)


@lru_cache(maxsize=4096)
def _mapped(uri: str, kinds: tuple) -> list[np.ndarray]:
    return _arrays(uri, kinds) if has_file(uri) else []


@lru_cache(maxsize=16)
def _read(uri: str, kinds: tuple) -> list[np.ndarray]:
    return _arrays(uri, kinds) if has_file(uri) else []


def _stored(uri: str, kinds: tuple) -> list[np.ndarray]:
    """A bucket's arrays, empty if it has none. Mapped ones cost no memory, so many are kept; of others the last few."""
    return (_mapped if uri.startswith("file:") else _read)(uri, kinds)


def block_scores(model: KneserNey, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: known tokens, log10 of the smoothed unigram base, log10 of the model."""
    first, second = _pairs(words)
    vocabulary, inverse = np.unique(np.concatenate((first, second)), return_inverse=True)
    f, s = inverse[: len(first)], inverse[len(first) :]
    n = len(vocabulary)
    total, own, before, gamma = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)

    def contexts(at: np.ndarray, stored: np.ndarray, *stats: np.ndarray) -> None:
        place, there = _find(stored, vocabulary[at])
        k, place = at[there], place[there]
        total[k], *kinds, own[k] = (_taken(*stats[i : i + 3], place) for i in range(0, 15, 3))
        gamma[k] = sum(d * x for d, x in zip(model.high[1:], kinds, strict=True)) / total[k]

    key, of_key = np.unique((f.astype(np.uint64) << np.uint64(32)) | s.astype(np.uint64), return_inverse=True)
    kf, ks = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = np.zeros(len(key), np.int64)
    key_hash = chain(vocabulary[kf], vocabulary[ks])
    for bucket, at in _slices(model.layout.of_pair(vocabulary[kf], vocabulary[ks])):
        if arrays := _stored(f"{model.folder}/bigrams-{bucket}", _BIGRAMS):
            at = at[np.argsort(key_hash[at])]
            place, there = _find(arrays[0], key_hash[at])
            count[at[there]] = _taken(*arrays[1:4], place[there])
    for bucket, at in _slices(model.layout.of_word(vocabulary)):
        if arrays := _stored(f"{model.folder}/bigrams-{bucket}", _BIGRAMS):
            contexts(at, *arrays[4:])
        if arrays := _stored(f"{model.folder}/unigrams-{bucket}", _UNIGRAMS):
            place, there = _find(arrays[0], vocabulary[at])
            before[at[there]] = _taken(*arrays[1:4], place[there])
            contexts(at, *arrays[4:])
    flat = 1.0 / (model.vocabulary + 1)
    if model.low_total:
        spare = float(np.dot(model.low[1:], model.low_kinds)) / model.low_total
        lower = np.maximum(before - model.low[np.minimum(before, 3)], 0) / model.low_total + spare * flat
    else:
        lower = np.full(n, flat)
    p = np.maximum(count - model.high[np.minimum(count, 3)], 0) / np.maximum(total[kf], 1) + gamma[kf] * lower[ks]
    if model.top is not None:
        p, of_key = _third(model, _before(first, second), vocabulary[kf], vocabulary[ks], of_key, p)
    own[vocabulary == END] = model.documents
    own[vocabulary == BEGIN] = 0
    base = np.log10((own + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
    size = np.array([len(w) + 1 for w in words], np.int64)
    text = np.repeat(np.arange(len(words)), size)
    add = lambda x: np.bincount(text, x, minlength=len(words))
    return add((own > 0)[s]).astype(np.int64), add(base[s]), add(np.log10(p)[of_key])


def _third(model: KneserNey, before: np.ndarray, first: np.ndarray, second: np.ndarray, of_pair: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the distinct trigrams of a block, and which each token has; given its distinct pairs, which each token has, and their probabilities."""
    words, of_word = np.unique(before, return_inverse=True)
    key, of_key = np.unique((of_pair.astype(np.uint64) << np.uint64(32)) | of_word.astype(np.uint64), return_inverse=True)
    pair = (key >> np.uint64(32)).astype(np.int64)
    u, v, w = words[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], first[pair], second[pair]
    context = chain(u, v)
    hashes = chain(context, w)
    count, total, gamma = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.ones(len(key))

    def contexts(at: np.ndarray, stored: np.ndarray, *stats: np.ndarray) -> None:
        at = at[np.argsort(context[at])]
        place, there = _find(stored, context[at])
        k, place = at[there], place[there]
        n, *kinds = (_taken(*stats[i : i + 3], place) for i in range(0, 12, 3))
        total[k], gamma[k] = n, sum(d * x for d, x in zip(model.top[1:], kinds, strict=True)) / n

    for bucket, at in _slices(model.layout.of_pair(v, w)):
        if arrays := _stored(f"{model.folder}/trigrams-{bucket}", _TRIGRAMS):
            by = at[np.argsort(hashes[at])]
            place, there = _find(arrays[0], hashes[by])
            count[by[there]] = _taken(*arrays[1:4], place[there])
            contexts(at, *arrays[4:])
    frequent, _ = model.layout.hot_words(v)
    for bucket, at in _slices(model.layout.of_word(context[frequent])):
        if arrays := _stored(f"{model.folder}/contexts-{bucket}", _CONTEXTS):
            contexts(frequent[at], *arrays)
    return np.maximum(count - model.top[np.minimum(count, 3)], 0) / np.maximum(total, 1) + gamma * p[pair], of_key


def score_texts(docs: DataFrame, model: KneserNey, block: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities) and perplexity of every row's whole text, its end included.

    Null and empty texts are one end mark. Rows stand for themselves: ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary_texts(b.column(1))
            for lo, hi in batches_by_bytes(texts, block):
                words = word_hashes(texts[lo:hi])
                known, base, score = block_scores(model, words)
                size = np.array([len(w) + 1 for w in words], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, (size, known, base, score, 10 ** np.minimum(-score / size, 300)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    small_batches(docs.sparkSession, 2048)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
