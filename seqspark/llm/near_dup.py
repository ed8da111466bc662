"""Near-duplicate documents by bottom-k sketches of word shingles, verified on the full shingle sets.

One hash function orders all shingles; a document keeps its k smallest hash values. The inverted lists of the
retained values generate overlaps; the k smallest values of the union of two sketches estimate their similarity;
pairs that pass lie in one *rough* component, and within rough components the full sets decide.

How no link is lost, and no group meets in one task:

* Documents with equal shingle sets are one class from the start.
* With a similarity of s or more, two classes share ``needed(s)`` of K retained values but for a chance of 3e-8 (binomial
  tail). So it is enough to index the K - needed + 1 rarest values of each sketch (any two sketches with that overlap share
  an indexed value), which drops passages that unrelated documents share before they form long lists. With ``sketch=None``
  the whole sets stand for the sketches, and no link can be lost.
* A list with over BLOCK members is cut into blocks and every pair of blocks is one group; a group emits a spanning
  forest of its passing pairs, not the pairs. Of more than PAIRED blocks, which are random samples of the list, the first is the hub: each other
  block is one group with it. What this leaves apart within a list is compared again: all members with those outside the list's largest
  component. In a large group of copies nearly all are linked with the hub, so rows are dealt in proportion to its members.
* A rough component with over BLOCK members, or with large sets, is cut in the same way (hub and outsiders too) for the exact check, which
  computes all intersections of a group as one matrix product and again emits a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import avalanche, binary_texts, chain, long_array, scratch, small_batches, word_hashes, written
from seqspark.llm.components import components, salted_join, with_least

K, BLOCK, BLOCK_VALUES = 32, 1024, 1 << 20
#: Blocks of one key up to which all pairs of them are compared at once.
PAIRED = 16
#: The chance at which a pair of just the wanted similarity may share fewer values than are asked for.
LOSS = 3e-8
WORD = r"[^\x20\x09-\x0D]"


def needed(percent: int, k: int) -> int:
    """How many of k retained values two sets of this similarity share, but for a chance of LOSS; 1 at least."""
    p, below, m = percent / 100, 0.0, 0
    while m < k and (below := below + math.comb(k, m) * p**m * (1 - p) ** (k - m)) <= LOSS:
        m += 1
    return max(m, 1)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct int64 hashes of a word sequence's shingles."""
    if not len(words):
        return np.zeros(0, np.int64)
    n = max(1, len(words) - width + 1)
    take = min(width, len(words))
    h = np.full(n, take, np.uint64)
    for j in range(take):
        h = chain(h, words[j : j + n])
    return np.unique(avalanche(h).view(np.int64))


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    return [shingle_set(w, width) for w in word_hashes(texts)]


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _signer(width: int, k: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(binary_texts(b.column(1)), width)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), long_array([s[:k] for s in sets])],
                names=["doc_id", "text_hash", "n_shingles", "cls", "sketch"],
            )

    return sign


class Forest:
    """Component labels of a group's members, flat at all times. Members of one ``known`` component are together from the start."""

    def __init__(self, known: np.ndarray):
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        self.known, self.label = known, first[of]
        self.joined = False

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.joined = True

    def edges(self) -> pa.RecordBatch | None:
        """What was joined, as stars between the components that were known."""
        if not self.joined:
            return None
        pairs = np.unique(np.stack((self.known, self.known[self.label])), axis=1)
        u, v = pairs[:, pairs[0] != pairs[1]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by its first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for hi in cut:
            held.append(b.slice(lo, hi - lo))
            yield pa.Table.from_batches(held)
            held, lo = [], hi
        held.append(b.slice(lo))
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def _overlaps(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of shared values, exact up to 2**24, from (value, owner) incidences."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    _, column = np.unique(group[many], return_inverse=True)
    o = o[many]
    out = np.zeros((n, n), np.float32)
    step = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            m = np.zeros((n, min(step, int(column[hi - 1] - column[lo]) + 1)), np.float32)
            m[o[lo:hi], column[lo:hi] - column[lo]] = 1
            out += m @ m.T
    return out


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Share of the k smallest values of the union of two sketches that both hold."""
    both = np.sort(np.concatenate((a, b)))
    same = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~same))
    rank = np.cumsum(distinct)
    least = min(k, int(rank[-1]))
    return float((same & (rank[1:] <= least)).sum()) / least


def _rough(percent: int, k: int, need: int) -> Callable:
    similarity, least = percent / 100, (need - 0.5) / k

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            n = g.num_rows
            if n < 2:
                continue
            size = g.column("n_shingles").to_numpy()
            flat = g.column("data").combine_chunks()
            values = np.asarray(flat.flatten())
            owner = np.repeat(np.arange(n), np.diff(np.asarray(flat.offsets)))
            sketch = np.split(values, np.searchsorted(owner, np.arange(1, n)))
            shared = _overlaps(values, owner, n)
            forest = Forest(g.column("label").to_numpy())
            for i in range(1, n):
                near = np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i])
                cands = np.flatnonzero(near & (shared[i, :i] >= np.minimum(need, np.ceil(similarity * np.maximum(size[:i], size[i]) - 1e-9))))
                cands = cands[np.argsort(-shared[i, cands], kind="stable")]
                roots = forest.label[cands]
                floor = similarity - 1e-9 if size[i] < k else least
                for r in np.unique(roots):
                    if r != forest.label[i]:
                        for j in cands[roots == r]:
                            if _estimate(sketch[i], sketch[j], k) >= (floor if size[j] < k else least):
                                forest.join(i, j)
                                break
            if (found := forest.edges()) is not None:
                yield found

    return lists


def _exact(percent: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            n = g.num_rows
            if n < 2:
                continue
            flat = g.column("data").combine_chunks()
            size = np.diff(np.asarray(flat.offsets)).astype(np.int64)
            shared = _overlaps(np.asarray(flat.flatten()), np.repeat(np.arange(n), size), n).astype(np.int64)
            forest = Forest(g.column("label").to_numpy())
            for i in range(1, n):
                union = size[i] + size[:i] - shared[i, :i]
                hits = np.flatnonzero(100 * shared[i, :i] >= percent * union)
                _, one = np.unique(forest.label[hits], return_index=True)
                for j in hits[one]:
                    forest.join(i, int(j))
            if (found := forest.edges()) is not None:
                yield found

    return blocks


def _linked(members: DataFrame, places: DataFrame, data: DataFrame, check: Callable, block: int, path: str) -> DataFrame:
    """(node, root) of the components that ``check`` finds among the members of each key.

    ``members`` has key, cls, n_blocks, n_shingles and data (of a class); the last two are in ``data`` by cls, and the first three in ``places`` for the keys with more than PAIRED blocks.
    """
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    own = F.pmod(F.xxhash64("cls", "key"), F.col("n_blocks")).cast("int").alias("own")

    def groups(rows: DataFrame) -> DataFrame:
        return rows.select("key", "own", "other", "label", "n_shingles", "data").repartition(parts, "key", "own", "other").sortWithinPartitions("key", "own", "other").mapInArrow(check, "u long, v long")

    pair = lambda a, b: F.struct(a.alias("own"), b.alias("other"))
    blocks = F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)
    all_pairs = F.transform(blocks, lambda b: pair(F.least(F.col("own"), b), F.greatest(F.col("own"), b)))
    hub = F.when(F.col("own") == 0, F.transform(F.slice(blocks, F.lit(2), F.greatest(F.lit(1), F.col("n_blocks").cast("int") - 1)), lambda b: pair(F.lit(0), b))).otherwise(F.array(pair(F.lit(0), F.col("own"))))
    first = F.when(F.col("n_blocks") <= PAIRED, all_pairs).otherwise(hub)
    dealt = members.select("key", own, "n_blocks", F.col("cls").alias("label"), "n_shingles", "data").select("key", F.explode(first).alias("at"), "label", "n_shingles", "data")
    within = components(groups(dealt.select("key", "at.own", "at.other", "label", "n_shingles", "data")), f"{path}/within")
    if places.isEmpty():
        return within
    # Keys with many blocks: each member meets those that are outside the key's largest component so far.
    labelled = written(places.join(within, F.col("cls") == F.col("node"), "left").select("key", own, "n_blocks", "cls", F.coalesce("root", "cls").alias("label")), f"{path}/labelled")
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.ceil((F.sum("n") - F.max("n")) / block).cast("int").alias("n_other")).where("n_other > 0")
    most = written(most, f"{path}/largest")
    if most.isEmpty():
        return within
    rows = salted_join(labelled, most, "key", "cls").join(data, "cls")
    other = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("n_other")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("n_other") - 1), lambda o: pair(F.col("own"), o))
    asked = F.transform(blocks, lambda b: pair(b, other))
    meetings = F.when(F.col("label") == F.col("largest"), met).otherwise(F.array_union(met, asked))
    both = rows.select("key", F.explode(meetings).alias("at"), "label", "n_shingles", "data").select("key", "at.own", "at.other", "label", "n_shingles", "data")
    # Links between components; what was a component before follows its root.
    across = components(groups(both), f"{path}/across")
    followed = salted_join(within, across.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "node", "left").select("node", F.coalesce("top", "root").alias("root"))
    return followed.unionByName(across.join(within.select(F.col("node")), "node", "left_anti").select("node", "root"))


def _first() -> Column:
    """Orders rows by id, then text hash; those without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")


def _components(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str, sketch: int | None = K) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and each class with its first row and the first of its component."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    k, block = (sketch, BLOCK) if sketch is not None else (2**31 - 1, max(1, BLOCK // 16))
    most = needed(percent, k) if sketch is not None else k
    spark = docs.sparkSession
    small_batches(spark)
    base = scratch(spark, "near-dup")
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sig = written(ids.mapInArrow(_signer(width, k), "doc_id long, text_hash long, n_shingles long, cls long, sketch array<long>"), f"{base}/signatures")
    classes = written(sig.where("n_shingles > 0").groupBy("cls").agg(F.min(_first()).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), f"{base}/classes")

    # Inverted lists of the rarest retained values.
    values = classes.select("cls", F.explode("sketch").alias("value"))
    frequency = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    need = F.least(F.lit(most), F.ceil(F.lit(percent / 100) * F.col("n_shingles") - 1e-9)).cast("int")
    shared = values.join(frequency, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("known"))
    known = written(classes.select("cls", "n_shingles").join(shared, "cls").select("cls", F.slice("known", F.lit(1), F.greatest(F.lit(0), F.size("known") - need + 1)).alias("known")), f"{base}/known")
    place = [F.col("x.value").alias("key"), "cls", F.ceil(F.col("x.df") / block).alias("n_blocks")]
    data = classes.select("cls", "n_shingles", F.col("sketch").alias("data"))
    lists = known.join(data, "cls").select("cls", "n_shingles", "data", F.explode("known").alias("x")).select(*place, "n_shingles", "data")
    long = known.select("cls", F.explode(F.filter("known", lambda x: x["df"] > PAIRED * block)).alias("x")).select(*place)
    rough = _linked(lists, long, data, _rough(percent, k, most), block, f"{base}/rough")

    # The full sets of the rough components' members, and the exact links within each.
    members = rough.join(classes.select("cls", "first", "n_shingles"), rough.node == classes.cls).select("cls", F.col("root").alias("key"), "first", "n_shingles")
    size = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_VALUES)).alias("n_blocks")).where("n_blocks > 1")
    cut = salted_join(members, size, "key", "cls", "left").select("key", "cls", "n_shingles", F.coalesce("n_blocks", F.lit(1)).alias("n_blocks"), "first")
    schema = "key long, cls long, n_shingles long, n_blocks long, data array<long>"

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            cls = b.column(1).to_pylist()
            at = [i for i, c in enumerate(cls) if c not in seen]
            sets = _sets(binary_texts(b.column(4).take(pa.array(at, pa.int64()))), width)
            # Texts of one id may share a hash, and rows may be repeated; each class wants its own set once.
            right = []
            for i, s in zip(at, sets, strict=True):
                if cls[i] not in seen and _class_of(s) == cls[i]:
                    seen.add(cls[i])
                    right.append((i, s))
            rows = pa.array([i for i, _ in right], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:4]), long_array([s for _, s in right])], names=["key", "cls", "n_shingles", "n_blocks", "data"])

    texts = cut.join(ids, cut["first"]["doc_id"].eqNullSafe(ids.doc_id) & (cut["first"]["text_hash"] == ids.text_hash)).select("key", "cls", "n_shingles", "n_blocks", "text")
    sets = written(texts.mapInArrow(full, schema).dropDuplicates(["cls"]), f"{base}/sets")
    exact = _linked(sets, sets.where(F.col("n_blocks") > PAIRED).select("key", "cls", "n_blocks"), sets.select("cls", "n_shingles", "data"), _exact(percent), block, f"{base}/exact")

    of = classes.select("cls", "first").join(exact.select(F.col("node").alias("cls"), "root"), "cls", "left")
    alone = of.where("root is null").select("cls", "first", F.col("first").alias("least"), F.col("cls").alias("root"))
    return sig, with_least(of.where("root is not null"), "root", "first", "cls").select("cls", "first", "least", "root").unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", sketch: int | None = K) -> DataFrame:
    """Classes of documents whose shingle sets are linked, directly or through others.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set has the distinct shingles of ``width`` words, or the whole
    sequence as one where there are fewer. Two documents are linked where ``100 * |A & B| >= percent * |A | B|``.

    Returns a row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id of the component), kept, cls (class of
    equal sets). Null or wordless texts have n_shingles 0 and are linked with nothing: component_id is their own id. A null id
    takes part with its text but never names a component unless nothing else does: then component_id is null and kept is true.
    Repeated rows fall in one class; each of them has ``kept`` if its id is the component's. Other columns are ignored.
    An empty table gives an empty result. A pair of just ``percent`` is overlooked with a chance of LOSS (less if it is more alike, none if a set has no
    more than ``sketch`` shingles); ``sketch=None`` compares whole sets and overlooks nothing, at the cost of lists for a share of all shingles. Classes
    are told apart by 64 bits of a digest of the set.
    """
    sig, named = _components(docs, width, percent, id_column, text_column, sketch)
    labels = named.select("cls", F.col("least.doc_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "cls").join(labels, "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cls")


def survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component, the first by id and text hash, and all rows whose text has no words."""
    _, named = _components(docs, width, percent, "doc_id", "text")
    first = named.where("first = least").select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    texts = docs.where(worded).withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    one = texts.join(first, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi").dropDuplicates(["__doc", "__text"])
    return one.drop("__doc", "__text").unionByName(docs.where(~worded))
