"""WARC archives that are read through an index.

Writing stores one gzip member per record and an index row (file, offset, length, url, digest). Reading starts from
the index: records are selected there, their byte ranges sorted and joined into runs, and each run is one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import filesystem, input_bytes, scratch, small_batches, write_file, written

DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, uri string, offset long, length long"
#: Bytes of a file before the next is begun, the largest gap that a read bridges, and the most bytes of a read with more than one record.
FILE_BYTES, GAP_BYTES, RUN_BYTES = 256 << 20, 64 << 10, 8 << 20


def payload_digest(column: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, from built-in functions."""
    # Base32 of 20 bytes: each 5 bytes (10 hex digits) are one number of 40 bits, written with 8 digits of 5 bits.
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digest = F.sha1(column)
    parts = []
    for k in range(4):
        number = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(alphabet, (F.shiftright(number, 35 - 5 * d).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for d in range(8)]
    return F.concat(*parts)


def record_bytes(kind: str, page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = f"{'' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {name}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record begins here")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}, payload


def _member(data: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=3, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stem = f"pages-{TaskContext.get().partitionId():06d}"
        schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in INDEX.split(", "))])
        parts: list[bytes] = []
        rows: list[tuple] = []
        at = 0

        def closed() -> pa.RecordBatch:
            uri = write_file(folder, stem, parts)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r[:6], uri, *r[6:]), strict=True)) for r in rows], schema=schema)

        for b in batches:
            for page_id, url, kind, refers_to, digest, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _member(record_bytes(kind, page_id, url, digest, refers_to, payload))
                rows.append((page_id, url, kind, refers_to, digest, len(payload), at, len(data)))
                parts.append(data)
                at += len(data)
                if at >= FILE_BYTES:
                    yield closed()
                    parts, rows, at = [], [], 0
        if rows:
            yield closed()

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index, itself a written table.

    The payload is the html in UTF-8, null counting as empty. Among payloads of at least ``least_bytes`` that are equal, the record with
    the largest page_id is the response and the others revisit it; smaller payloads are always responses. Rows that repeat that
    largest id are responses too. Rows with a null id are responses if no equal payload has an id, else revisits. Urls may be
    null; further columns are ignored; an empty table gives an empty index. Files are named for task attempts.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # Only ids and digests are grouped; the pages themselves meet the far smaller table of repeated digests. That is written first: by its size it is
    # broadcast, or else both sides are shuffled for the join alone, and adaptive execution splits the partition of a hot digest over several tasks.
    signed = rows.withColumn("digest", payload_digest(F.col("payload")))
    again = signed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null").select("digest", "newest")
    again = written(again, f"{folder}/repeated")
    joined = signed.join(again, "digest", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    records = joined.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("newest")).alias("refers_to"), "digest", "payload")
    return written(records.mapInArrow(_writer(folder), INDEX), f"{folder}/index")


def read_records(selected: DataFrame) -> DataFrame:
    """The records of index rows (uri, offset, length), parsed: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Ranges of a file are sorted by offset; those with gaps up to GAP_BYTES are read at once, up to about RUN_BYTES. A revisit's
    payload is null; its length is that in its HTTP header and its digest that of the record. A response whose payload doesn't have the recorded digest is an error.
    An empty selection gives no records; an index row that is selected more than once gives one record; further columns are ignored.
    """
    by_file = Window.partitionBy("uri").orderBy("offset")
    ranges = selected.select("uri", "offset", "length").distinct()
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file)
    fresh = F.when(gap.isNull() | (gap > GAP_BYTES) | (F.floor(F.col("offset") / RUN_BYTES) > F.floor(F.lag("offset").over(by_file) / RUN_BYTES)), 1).otherwise(0)
    runs = ranges.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_file)).groupBy("uri", "run").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = filesystem(uri)
                first = parts[0]["offset"]
                with fs.open_input_file(path) as f:
                    f.seek(first)
                    data = f.read(parts[-1]["offset"] + parts[-1]["length"] - first)
                rows = []
                for p in parts:
                    lo = p["offset"] - first
                    warc, http, payload = parse_record(zlib.decompress(data[lo : lo + p["length"]], wbits=31))
                    response, digest = warc["warc-type"] == "response", warc["warc-payload-digest"].removeprefix("sha1:")
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{uri} at {p['offset']}: the payload doesn't match its digest")
                    number = lambda k, w=warc: int(w[k]) if w.get(k) else None
                    rows.append((number("x-page-id"), len(payload) if response else int(http["content-length"]), digest, warc["warc-type"], number("x-refers-to-page-id"), warc.get("warc-target-uri"), payload if response else None))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    parts = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(selected) // (64 << 20) + 1)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return runs.select("uri", "parts").repartition(parts, "uri", F.col("parts")[0]["offset"]).mapInArrow(run, schema)
