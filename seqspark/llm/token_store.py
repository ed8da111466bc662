"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id; level l holds the l-th chunk of the
ids that reach it. A bitmap beside each level says which ids continue, and a rank directory (ones before each 512 bits) finds
an id's place on the next level. So any id is read in as many steps as it has chunks, without decoding a block.

File: magic, counts (documents, ids, levels), document ids, their validity, ends of documents in ids; for each level the number of chunks, the chunks,
the bitmap as 64-bit words, the directory as 32-bit counts. Little-endian, each part padded to 8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import SPACE, binary_texts, input_bytes, map_file, scratch, small_batches, write_file, written

MAGIC = b"DACIDS01"
CHUNK, RANK_BITS = 8, 512
#: Pieces that a worker remembers while encoding.
MEMO = 800_000
#: A control character that stands between words in a call of the tokenizer; words that hold it are encoded by themselves.
SEPARATOR = "\x01"


def _padded(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def dac_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """A file's parts."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest) or not levels:
        more = rest >> np.uint64(CHUNK) > 0
        bits = np.packbits(more, bitorder="little")
        words = np.zeros((len(rest) + 63) // 64, np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words).astype(np.uint32)
        step = RANK_BITS // 64
        ones = np.concatenate((ones, np.zeros(-len(ones) % step, np.uint32))).reshape(-1, step).sum(1, dtype=np.uint32)
        rank = np.cumsum(ones, dtype=np.uint32) - ones
        levels += [_padded(np.array([len(rest)], np.int64)), _padded((rest & np.uint64(255)).astype(np.uint8)), _padded(words), _padded(rank)]
        rest = rest[more] >> np.uint64(CHUNK)
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], np.int64)
    return [MAGIC, _padded(np.array([len(doc_ids), len(ids), len(levels) // 4], np.int64)), _padded(numbers), _padded(known), _padded(np.asarray(ends, np.int64)), *levels]


class DacFile:
    """Random access to the ids of one file, over its mapped bytes."""

    def __init__(self, data: np.ndarray):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self._data, self._at = data, 8
        self.n_docs, self.n_ids, n_levels = (int(x) for x in self._take(3, np.int64))
        numbers, known = self._take(self.n_docs, np.int64), self._take(self.n_docs, np.uint8)
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.ends = self._take(self.n_docs, np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take(1, np.int64)[0])
            words = (n + 63) // 64
            self.levels.append((self._take(n, np.uint8), self._take(words, np.uint64), self._take((words * 64 + RANK_BITS - 1) // RANK_BITS, np.uint32)))

    def _take(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = self._data[self._at : self._at + size].view(kind)
        self._at += size + (-size % 8)
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places of the file."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("no such token")
        out = np.zeros(len(at), np.uint32)
        who = np.arange(len(at))
        for level, (chunks, words, rank) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            more = (words[word] >> bit) & np.uint64(1) > 0
            who, at, word, bit = who[more], at[more], word[more], bit[more]
            if not len(who):
                break
            # Rank: the directory, whole words since it, and the bits below in this word.
            first = (word >> 3) << 3
            ones = rank[word >> 3].astype(np.int64)
            for k in range(RANK_BITS // 64 - 1):
                inside = first + k < word
                ones[inside] += np.bitwise_count(words[first[inside] + k])
            at = ones + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return out

    def _ones(self, level: int, place: int) -> int:
        """Set bits before a place of a level."""
        _, words, rank = self.levels[level]
        word = place >> 6
        if word >= len(words):
            return int(np.bitwise_count(words).sum()) if len(words) else 0
        first = word >> 3 << 3
        return int(rank[word >> 3]) + int(np.bitwise_count(words[first:word]).sum()) + (int(words[word]) & ((1 << (place & 63)) - 1)).bit_count()

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Ids of neighbouring places: those that continue are neighbours on the next level too, so one rank a level is enough."""
        out = np.zeros(hi - lo, np.uint32)
        who = slice(None)
        for level, (chunks, words, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[who] |= chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK * level)
            more = np.unpackbits(words.view(np.uint8)[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo] > 0
            who = np.flatnonzero(more) if isinstance(who, slice) else who[more]
            lo = self._ones(level, lo)
            hi = lo + len(who)
        return out

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def docs(self, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of every document, read many at a time."""
        first = 0
        while first < self.n_docs:
            begin = int(self.ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, begin + at_once, side="right")))
            yield from np.split(self.range(begin, int(self.ends[last - 1])), self.ends[first : last - 1] - begin)
            first = last


#: Classes of bytes: letters (ASCII, and the lead byte of U+00C0 to U+00FF), digits, other printable ASCII but the apostrophe, and what only stands in unsplit runs.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = 0
_KIND[48:58] = 1
_KIND[ord("'")] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with capitals of plain runs lowered, and where pieces start and end.

    A run of non-space bytes is plain if it has only letters up to U+00FF, digits and ASCII signs, but no apostrophe and no "<|", with which
    special tokens begin. A plain run is cut where letters, digits and signs meet, as the tokenizer does, and lower-cased, which it does too; any
    other run is one piece as it stands.
    """
    a = np.frombuffer(block, np.uint8)
    space = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return a, start, end
    kind = _KIND[a]
    after = np.zeros(len(a), bool)
    after[1:] = a[:-1] == 0xC3
    kind[after] = np.where((a[after] == 0x97) | (a[after] == 0xB7), 3, 0)  # signs of multiplication and division
    odd = (kind == 3) & ~space
    odd[:-1] |= (a[:-1] == 60) & (a[1:] == 124)
    strange = np.add.reduceat(odd, start, dtype=np.int64) > 0
    # Bytes of plain runs, by a running sum over the runs' edges.
    inside = np.zeros(len(a) + 1, np.int8)
    inside[start[~strange]] += 1
    inside[end[~strange]] -= 1
    plain = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lowered = np.where(plain, _LOWER[a], a)
    upper = after & plain & (a >= 0x80) & (a <= 0x9E)
    lowered[upper] += 32
    cut = np.flatnonzero(plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])) + 1
    if len(cut):
        start = np.sort(np.concatenate((start, cut)))
        end = np.sort(np.concatenate((end, cut)))
    return lowered, start, end


#: Files whose sizes one window sums up.
GROUP = 1024
#: Bytes of the longest piece that a memo holds: three numbers less the byte for its length.
SHORT = 23


class Memo:
    """Ids of pieces that were encoded before. A piece of up to SHORT bytes is looked up by its very bytes and their number, as three numbers in an open-addressing table."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.slot = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros((0, 3), np.uint64)
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.key)

    def _home(self, key: np.ndarray) -> np.ndarray:
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ key[:, 2] * np.uint64(0x165667B19E3779F9)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        todo, home = np.arange(len(key)), self._home(key)
        while len(todo):
            place = self.slot[home]
            held = place >= 0
            todo, home, place = todo[held], home[held], place[held]
            hit = (self.key[place] == key[todo]).all(1)
            out[todo[hit]] = place[hit]
            todo, home = todo[~hit], (home[~hit] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """New distinct keys with their ids."""
        first = len(self.key)
        self.key = np.concatenate((self.key, key))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))
        todo, home = np.arange(first, len(self.key), dtype=np.int32), self._home(key)
        while len(todo):
            free = self.slot[home] < 0
            self.slot[home[free]] = todo[free]  # of keys that want one slot, one wins
            lost = self.slot[home] != todo
            todo, home = todo[lost], (home[lost] + 1) & ((1 << self.bits) - 1)


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Three little-endian numbers that hold the bytes of each piece of up to SHORT and, in the last byte, how many they are; what lies between is zero. Of longer pieces the numbers are no keys."""
    padded = np.concatenate((data, np.zeros(32, np.uint8)))
    loads = np.ndarray(len(data) + 24, "<u8", padded, 0, (1,))
    size = end - start
    key = np.empty((len(start), 3), np.uint64)
    for k in range(3):
        left = np.clip(size - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(left == 8, np.uint64(2**64 - 1), (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        key[:, k] = loads[np.minimum(start + 8 * k, len(data))] & mask
    key[:, 2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    return key


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece of a text (see ``pieces``) once.

    Right for tokenizers whose normaliser lower-cases and whose splitter neither looks nor merges across ASCII white space, nor where letters, digits and signs
    meet, and gives white space no tokens. The constructor checks that on samples, and every worker on the first texts that it sees; where it
    doesn't hold, whole texts are encoded.
    """

    SAMPLES = ("a b", " A  b\n\nc's\t12 3", "x \u0301y e \u0308\n", "One,two...THREE--4th (\u00c9t\u00c9\u00df), 3,141.5%%% \u00d7\u00f7 <|endoftext|>;")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._whole(SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 and self._whole(f"a {SEPARATOR} b") == self._whole("a") + mark + self._whole("b") else None
        self.memo = Memo()
        self.by_piece = True
        self._check([x.encode() for x in self.SAMPLES])
        self.checked = not self.by_piece

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _check(self, texts: list[bytes]) -> None:
        found = self._by_piece(texts, 0)
        self.by_piece = self.by_piece and all(x[:-1].tolist() == self._whole(t.decode("utf-8", "replace")) for x, t in zip(found, texts, strict=True))

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. Many go in one call, with a control character between them."""
        odd = {i for i, w in enumerate(words) if SEPARATOR in w} if self.mark is not None else set(range(len(words)))
        plain = [w for i, w in enumerate(words) if i not in odd] if odd else words
        lines = [f" {SEPARATOR} ".join(plain[i : i + 512]) + f" {SEPARATOR}" for i in range(0, len(plain), 512)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))])
        count = np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1
        flat = ids[ids != self.mark]
        if odd:
            by_word = dict(zip((i for i in range(len(words)) if i not in odd), np.split(flat, np.cumsum(count)[:-1]), strict=False))
            parts = [by_word[i] if i in by_word else np.array(self._whole(w), np.uint32) for i, w in enumerate(words)]
            flat, count = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, count

    def _by_piece(self, texts: list[bytes], last: int) -> list[np.ndarray]:
        data, start, end = pieces(b" ".join(texts))
        raw, size = data.tobytes(), end - start
        key = _keys(data, start, end)
        short = np.flatnonzero(size <= SHORT)
        at = np.full(len(start), -1, np.int64)
        at[short] = self.memo.find(key[short])
        missing = short[at[short] < 0]
        if len(missing):
            # One of each, sorted by their first bytes; the same three numbers are the same piece.
            order = missing[np.lexsort((key[missing, 2], key[missing, 1], key[missing, 0]))]
            fresh = np.concatenate(([True], (key[order[1:]] != key[order[:-1]]).any(1)))
            first = order[fresh]
            if len(self.memo) + len(first) > MEMO:
                self.memo = Memo()
                return self._by_piece(texts, last) if len(first) < MEMO // 2 else [x for t in texts for x in self._alone(t, last)]
            flat, count = self._distinct([raw[i:j].decode("utf-8", "replace") for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            place = len(self.memo) + np.cumsum(fresh) - 1
            self.memo.add(key[first], flat, count)
            at[order] = place
        flat, begin, count = self.memo.flat, self.memo.start[at], self.memo.count[at]
        long = np.flatnonzero(size > SHORT)
        if len(long):
            own, n = self._distinct([raw[i:j].decode("utf-8", "replace") for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            begin[long], count[long] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate((flat, own))
        stop = np.cumsum(count)
        ids = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)]
        # A text ends where the pieces that start in it do.
        ends = np.concatenate(([0], stop))[np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))]
        ids = np.insert(ids, ends, last)
        return np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])

    def _alone(self, text: bytes, last: int) -> list[np.ndarray]:
        return [np.array([*self._whole(text.decode("utf-8", "replace")), last], np.uint32)]

    def encode(self, texts: list[bytes], last: int) -> list[np.ndarray]:
        """uint32 ids of each text with ``last`` behind them."""
        if not self.checked and texts:
            self.checked = True
            self._check([t for t in texts[:4] if len(t) <= 1 << 16])
        if not self.by_piece:
            return [x for t in texts for x in self._alone(t, last)]
        return self._by_piece(texts, last) if texts else []


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _writer(folder: str, path: str, last: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from seqspark.llm.common import batches_by_bytes

        encode = word_encoder(path).encode
        doc_ids, ids = [], []
        for b in batches:
            texts = binary_texts(b.column(1))
            for lo, hi in batches_by_bytes(texts):
                ids += encode(texts[lo:hi], last)
            doc_ids += b.column(0).to_pylist()
        if doc_ids:
            ends = np.cumsum([len(x) for x in ids])
            part = TaskContext.get().partitionId()
            uri = write_file(folder, f"tokens-{part:06d}", dac_bytes(doc_ids, ends, np.concatenate(ids)))
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(doc_ids)], "n_ids": [int(ends[-1])]}, schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, tokenizer: str, last: int = 1, folder: str | None = None) -> DataFrame:
    """Encodes every whole text (null: empty), appends ``last`` to each, and writes the ids in ascending order of doc_id.

    The rows are range-partitioned by (doc_id, text), a file for each partition; null ids come first and rows with one id are ordered by text.
    Returns the manifest, itself a written table: part, uri, n_docs, n_ids, first (ids in earlier files). An empty table gives
    no files. A file is named for its task attempt, so files of lost attempts are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(input_bytes(docs) // (16 << 20)) + 1)
    dealt = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = written(dealt.mapInArrow(_writer(folder, tokenizer, last), "part int, uri string, n_docs long, n_ids long"), f"{folder}/manifest")
    # Sums in two levels: within groups of files, and of whole groups before.
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = files.withColumn("group", F.floor(F.col("part") / GROUP))
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", earlier(Window.orderBy("group")).alias("before"))
    within = grouped.withColumn("within", earlier(Window.partitionBy("group").orderBy("part")))
    return within.join(F.broadcast(groups), "group").select("part", "uri", "n_docs", "n_ids", (F.col("before") + F.col("within")).cast("long").alias("first"))  # a row for each GROUP files


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = DacFile(map_file(uri))
                crc = [zlib.crc32(np.ascontiguousarray(ids, "<u4")) for ids in f.docs()]
                begin = np.concatenate(([0], f.ends[:-1])) if f.n_docs else f.ends
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(begin + first), pa.array(f.ends - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri", "first").repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Single tokens: ``wanted`` has ``place`` (a global position); returns place and id. Places outside are dropped."""
    spans = manifest.select("uri", "first", (F.col("first") + F.col("n_ids")).alias("end"))
    width = manifest.agg(F.greatest(F.lit(1), F.max("n_ids"))).first()[0] or 1
    lo, hi = F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width)
    spans = spans.withColumn("cell", F.explode(F.sequence(lo, hi)))
    at = wanted.select("place", F.floor(F.col("place") / width).alias("cell")).join(spans, "cell").where("place >= first and place < end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, DacFile] | None = None
        for b in batches:
            uris, place, first = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
            for uri in dict.fromkeys(uris):
                if not opened or opened[0] != uri:
                    opened = uri, DacFile(map_file(uri))
                k = uris == uri
                yield pa.RecordBatch.from_arrays([pa.array(place[k]), pa.array(opened[1].take((place - first)[k]).astype(np.int64))], names=["place", "id"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return at.select("uri", "place", "first").repartition(parts, "uri").sortWithinPartitions("uri").mapInArrow(run, "place long, id long")
