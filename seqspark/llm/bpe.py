"""Byte-level BPE: pieces of a length bucket are rows of one matrix, and every row merges its leftmost pair of least rank in a round.

Pieces over ``WIDEST`` bytes are one flat row of links instead, with the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import batches_by_bytes, binary_texts, small_batches

NONE = np.int32(2**31 - 1)
#: Matches that a worker remembers, and the longest that it keeps.
MEMO, MEMO_CHARS = 400_000, 4096
#: Bytes of the widest length bucket; longer matches are linked instead, since a row of n bytes would take n rounds over n columns.
WIDEST = 256


class PairTable:
    """Open addressing over (left id, right id) -> merged id; a lookup probes for all keys at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            self.key[slot[free]] = key[free]  # of keys that want one slot, one wins
            won = todo[self.key[slot[todo]] == key[todo]]
            self.value[slot[won]] = merged[won]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair is none; negative ids are in no pair."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | right).ravel()
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            seen = self.key[slot]
            hit = seen == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            more = ~hit & (seen != -1)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Vocabulary:
    """A rank file: base64 token and rank on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.of_byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level vocabulary has a token for every byte")
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a = np.array(rows, np.int64).reshape(-1, 3)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32))

    def _wide(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of long pieces one after the other and how many each has, by links within one flat row.

        Places wait under the rank of the pair that begins there, and the least rank is taken first, all its places at once from left to right. Should a merge
        make a pair of still lower rank, the places behind it wait again, so the order is that of one merge at a time; yet the
        work is about that of the merges, whatever the length.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].copy()
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(size)
        after[ends - 1], before[ends - size] = -1, -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pairs.find(ids[inner], ids[inner + 1])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, group in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(places, cut), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        first = inner[rank[inner] != NONE]
        if len(first):
            wait(first, rank[first])
        while heap:
            m = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(m)))
            at = at[rank[at] == m]
            if not len(at):
                continue
            # Of places that follow each other every second one merges.
            fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            right = after[at]
            behind, ahead = after[right], before[at]
            merged = np.full(len(at), m, np.int32)
            # The pairs that a merge makes, seen when all merges to its left are done and none to its right.
            left_id = np.where(ahead >= 0, ids[ahead], -1)
            left_id[1:][ahead[1:] == right[:-1]] = m  # the token ahead is just being merged
            made = np.minimum(self.pairs.find(left_id, merged), self.pairs.find(merged, np.where(behind >= 0, ids[behind], -1)))
            lower = np.flatnonzero(made < m)
            if len(lower) and lower[0] + 1 < len(at):
                k = int(lower[0]) + 1
                wait(at[k:], rank[at[k:]])
                at, right, behind = at[:k], right[:k], behind[:k]
            ids[at], after[at] = m, behind
            before[behind[behind >= 0]] = at[behind >= 0]
            rank[right], ids[right] = NONE, -1
            changed = np.unique(np.concatenate((at, before[at])))
            changed = changed[changed >= 0]
            nexts = after[changed]
            now = np.where(nexts >= 0, self.pairs.find(ids[changed], np.where(nexts >= 0, ids[nexts], -1)), NONE)
            rank[changed] = now
            if (now != NONE).any():
                wait(changed[now != NONE], now[now != NONE])
        kept = ids >= 0
        return ids[kept], np.add.reduceat(kept.astype(np.int64), ends - size)

    def _bucket(self, data: bytes, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of at most ``width`` bytes, all bytes in ``data``: a row of ids for each, and how many it holds."""
        column = np.arange(width)
        ids = np.full((len(size), width), -1, np.int32)
        ids[column < size[:, None]] = self.of_byte[np.frombuffer(data, np.uint8)]
        final, left = ids.copy(), size.copy()
        row, rank = np.arange(len(size)), self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            go = best != NONE
            if not go.all():
                done = row[~go]
                final[done, : ids.shape[1]], left[done] = ids[~go], size[~go]
                row, ids, rank, size, at, best = row[go], ids[go], rank[go], size[go], at[go], best[go]
                if not len(row):
                    break
            # Merge at ``at``; what stands behind moves up by one, so the matrix gets narrower by one column.
            w, r = ids.shape[1] - 1, np.arange(len(row))
            ids[r, at] = best
            behind = column[:w] > at[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            size = size - 1
            if w == 1:
                rank = np.full((len(row), 1), NONE, np.int32)
                continue
            rank = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self.pairs.find(ids[k, at[k] - 1], ids[k, at[k]])
            k = np.flatnonzero(at < w - 1)
            rank[k, at[k]] = self.pairs.find(ids[k, at[k]], ids[k, at[k] + 1])
        return final, left

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many ids each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        count = np.where(whole >= 0, 1, 0)
        width = np.where(size <= 32, (size + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        width[(whole >= 0) | (size == 0)] = 0
        found = []
        for w in np.unique(width[(width > 0) & (width <= WIDEST)]):
            of_width = np.flatnonzero(width == w)
            for lo in range(0, len(of_width), 8192):
                m = of_width[lo : lo + 8192]
                ids, left = self._bucket(b"".join([pieces[i] for i in m]), size[m], int(w))
                count[m] = left
                found.append((m, ids, left))
        wide = np.flatnonzero(width > WIDEST)
        if len(wide):
            long_ids, count[wide] = self._wide([pieces[i] for i in wide])
        start = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        flat[start[whole >= 0]] = whole[whole >= 0]
        for m, ids, left in found:
            inside = np.arange(ids.shape[1]) < left[:, None]
            flat[(start[m][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        if len(wide):
            n = count[wide]
            flat[np.arange(n.sum()) + np.repeat(start[wide] - (np.cumsum(n) - n), n)] = long_ids
        return flat, count


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Splits texts by a pattern and encodes each match by itself; remembers what it encoded, up to MEMO short matches."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary(path), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        flat, count = self.vocabulary.encode([p.encode() for p in new])
        self.place.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))

    def encode_batch(self, texts: list[str], size: int = 1 << 20) -> Iterator[np.ndarray]:
        """An int32 array of ids for each text."""
        for lo, hi in batches_by_bytes(texts, size):
            matches = [self.find(t) for t in texts[lo:hi]]
            new = {p for m in matches for p in m if p not in self.place}
            if len(self.place) + len(new) > MEMO:
                self._forget()
                new = {p for m in matches for p in m}
            if new:
                self._learn(list(new))
            get = self.place.__getitem__
            at = np.fromiter((k for m in matches for k in map(get, m)), np.int64, sum(map(len, matches)))
            count = self.count[at]
            end = np.cumsum(count)
            ids = self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[at] - (end - count), count)]
            of_text = np.cumsum([len(m) for m in matches])
            ends = np.concatenate(([0], end))[of_text]
            yield from np.split(ids, ends[:-1])
            if any(len(p) > MEMO_CHARS for p in new):
                self._forget()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encode(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in binary_texts(b.column(1))]
            for lo in range(0, len(texts), 64):
                ids = list(e.encode_batch(texts[lo : lo + 64]))
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, null counting as empty; no special tokens.

    ``path`` is a rank file on every worker. Ids equal those of the tiktoken library: each match of ``pattern`` is encoded by
    itself, as one token where it is one, else by merging its leftmost pair of least rank again and again. An empty text has
    no ids. Ids and other columns may be null or repeated; each row gives one row, and an empty table gives an empty one. Texts of any length are taken whole: a
    long match is linked in one flat row, with work that grows with its merges.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, columns: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``columns`` and the decoded bytes of each row's ids; null ids decode to nothing."""
    schema = encoded.select(*columns, F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for b in batches:
            data = [b"".join(map(tokens.__getitem__, x or ())) for x in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(data, pa.binary())], names=[*columns, "decoded"])

    return encoded.select(*columns, "ids").mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of a round trip in one pass: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = []
            for found in e.encode_batch([t.decode("utf-8", "replace") for t in binary_texts(b.column(1))]):
                ids = found.tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
