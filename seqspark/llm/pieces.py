"""SentencePiece encoding by a table of distinct chunks: where no piece crosses a white-space marker, each distinct marked word is segmented once and its ids are joined back by position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import batches_by_bytes, binary_texts, long_array, small_batches

MARKER = "▁"
#: Bytes of text that share a table of chunks; a longer text has one to itself.
BLOCK = 8 << 20


def _crosses(piece: str) -> bool:
    """Whether a marker stands behind another character."""
    return MARKER in piece.lstrip(MARKER)


def chunks(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All chunks of all texts, and how many each text has. A chunk is a run of spaces with what follows up to the next space.

    One space is put before each text that isn't empty, as the model does, so every chunk begins with one. Markers in a text count as spaces.
    """
    marked = MARKER.encode()
    texts = [t.replace(marked, b" ") if marked in t else t for t in texts]
    full = np.array([len(t) > 0 for t in texts], bool)
    data = b"".join(b" " + t for t in texts if t)
    if not data:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    space = np.frombuffer(data, np.uint8) == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts if t])
    start[begin[:-1]] = True
    place = np.append(np.flatnonzero(start), len(data)).astype(np.int32)
    count = np.zeros(len(texts), np.int64)
    count[full] = np.diff(np.searchsorted(place, begin))
    return pa.Array.from_buffers(pa.string(), len(place) - 1, [None, pa.py_buffer(place), pa.py_buffer(data)]), count


class Pieces:
    """A SentencePiece model and what holds for its pieces."""

    PROBE = " a  b\tc 　ﬁ Å "

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        marker = self.model.piece_to_id(MARKER)
        plain = self.model.normalize(self.PROBE) == MARKER + self.PROBE.replace(" ", MARKER)
        #: Whether texts may be cut before markers: spaces only become markers, one is put in front, and no piece has one inside.
        self.separable = plain and marker != self.model.unk_id() and not any(_crosses(self.model.id_to_piece(i)) for i in range(n))
        self.marker = marker

    def _flat(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum())), count

    def segment(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and how many each has. The model itself puts the first marker back; a lone one it would drop."""
        return self._flat([ids or [self.marker] for ids in self.model.encode([c[1:] for c in distinct], num_threads=1)])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """An int32 array of ids for each text, without an end."""
        for lo, hi in batches_by_bytes(texts, BLOCK):
            if not self.separable:
                flat, of_text = self._flat(self.model.encode([t.decode("utf-8", "replace") for t in texts[lo:hi]], num_threads=1))
                yield from np.split(flat, np.cumsum(of_text)[:-1])
                continue
            found, of_text = chunks(texts[lo:hi])
            table = found.dictionary_encode()
            place = table.indices.to_numpy(zero_copy_only=False)
            ids, size = self.segment(table.dictionary.to_pylist())
            start, n = np.cumsum(size) - size, size[place]
            end = np.cumsum(n)
            flat = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(start[place] - (end - n), n)]
            yield from np.split(flat, np.concatenate(([0], end))[np.cumsum(of_text)][:-1])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def piece_encode(docs: DataFrame, path: str, last: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text as the sentencepiece library encodes it, without sampling; ``last`` is put at the end of each.

    ``path`` is a model on every worker. Null counts as the empty text, which has no ids but the last. Ids and other columns
    may be null, repeated or of any name, an empty table gives an empty one, and each row gives one row. Texts of any length are taken whole;
    a text over ``BLOCK`` bytes has a chunk table to itself. Where a model's pieces may cross markers, or it changes texts
    otherwise, whole texts are segmented instead, with the same ids.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, end = pieces(path), np.array([] if last is None else [last], np.int32)
        for b in batches:
            found = [np.concatenate((x, end)) for x in p.encode(binary_texts(b.column(1)))]
            for lo in range(0, len(found), 64):
                part = found[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 64), long_array(part).cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def piece_decode(encoded: DataFrame, path: str, columns: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``columns`` and the text (decoded) of each row's ids, as the library decodes them; null ids are no ids."""
    schema = encoded.select(*columns, F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path).model
        for b in batches:
            ids = [x or [] for x in b.column(len(columns)).to_pylist()]
            texts = model.decode(ids, num_threads=1) if ids else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return encoded.select(*columns, "ids").mapInArrow(run, schema)
