"""What several operators share: scratch folders, file systems, byte batches and vectorised word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def _findable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder."""
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, env.get("PYTHONPATH")) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none, and in local mode alone (tests), a temporary folder is made and set.
    """
    _findable(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/seqspark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table written once: later reads neither recompute it nor lose it with an executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, parts: list[bytes], final: bool = False) -> str:
    """Writes a file under a name of this attempt alone, so a retried or speculative task never touches another's.

    With ``final`` it is then moved to ``stem`` itself. That is for contents that every attempt makes alike: whichever comes last stands, and it is whole.
    """
    uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}"
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as f:
        for x in parts:
            f.write(x)
    if not final:
        return uri
    _, target = filesystem(f"{folder}/{stem}")
    try:
        fs.move(path, target)
    except OSError:  # some file systems don't move onto a file that is there
        if fs.get_file_info(target).type != pafs.FileType.File:
            raise
        fs.delete_file(path)
    return f"{folder}/{stem}"


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where it is on a mounted path, else read into memory."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def has_file(uri: str) -> bool:
    fs, path = filesystem(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the input's size, for choosing numbers of partitions; 0 where it knows nothing, as of rows that the driver made."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Holds Arrow batches small, since whole texts may be long."""
    _findable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id as text. A null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def long_array(values: list[np.ndarray]) -> pa.Array:
    """A list<int64> array from numpy arrays."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def batches_by_bytes(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


# Polynomial hash of a word's bytes modulo 2**64 with a random value for each byte, then an avalanche.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2B
_INVERSE = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def avalanche(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence longer by one from that of the sequence and that of the next word."""
    return avalanche(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        if size == 1 << 20 or len(_POWERS) < 2:
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        else:
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _hash_block(block: bytes, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, or of their first ``prefix`` bytes, and where they start."""
    a = np.frombuffer(block, np.uint8)
    space = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers(len(a))
    if prefix is not None:
        end = np.minimum(end, start + prefix)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return avalanche(h + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), start


def _cuts(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that end at white space; a longer word stays whole."""
    lo = 0
    while len(text) - lo > limit:
        hi = lo + limit
        while hi < len(text) and not SPACE[text[hi]]:
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the 64-bit hashes of its words, ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order. Blocks are small, as a worker has several arrays of eight times their size."""
    out: list[np.ndarray] = []
    for lo, hi in batches_by_bytes(texts, 1 << 19):
        if hi - lo == 1 and len(texts[lo]) > 4 << 20:
            out.append(np.concatenate([_hash_block(x.lower())[0] for x in _cuts(texts[lo], 1 << 20)]))
            continue
        h, start = _hash_block(b" ".join(texts[lo:hi]).lower())
        sizes = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
        out += np.split(h, np.searchsorted(start, np.cumsum(sizes)[:-1]))
    return out


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def prefix_hashes(texts: list[bytes], prefixes: tuple[int | None, ...], limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each prefix length (None: whole words) and each block of texts: place of the length, hashes, and the text that each is of. Blocks are small, as a worker has several arrays of eight times their size."""
    for lo, hi in batches_by_bytes(texts, limit):
        block = b" ".join(texts[lo:hi]).lower()
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        for k, p in enumerate(prefixes):
            h, start = _hash_block(block, p)
            yield k, h, lo + np.searchsorted(ends, start, side="right")
