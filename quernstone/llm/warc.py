"""WARC archives: a writer and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of an archive and knows nothing of
the rest: it scans for gzip magic, takes a candidate only if its first bytes inflate to a WARC header and, as long as no record
is known to end there, if the member inflates to its end (with the right checksum) and the next member or the file's end follows.
A task owns the records that start inside its range and reads the last of them past the range's end; so every
record is read once, by whatever ranges.

Records with equal payloads: the one with the largest page id holds the payload, others are ``revisit`` records that
refer to it; payloads below ``min_revisit_bytes`` are all stored.

Defined results: a null payload is an empty one; null page ids never hold a payload for others, and refer to one if
there is an id to refer to; rows that repeat the largest id are all responses; null URLs get a URN; an empty table
gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.staging import bounded_batches, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member."""
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    deflate = zlib.compressobj(level, wbits=31)
    return deflate.compress(head + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    target = "".join(c for c in url if c > " ") if url else f"urn:page:{page_id}"
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return member(headers, http + payload)
    return member([*headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def with_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """``page_id, url, payload, refers_to``; payloads are not shuffled unless there are very many revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keys = rows.where(F.length("payload") >= min_revisit_bytes).select("page_id", F.sha1("payload").alias("digest"))
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null")
    # Pairs of two short columns; a digest with very many pages is split by adaptive execution.
    revisits = staged(keys.join(groups, "digest").where("not page_id <=> holder").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("holder").alias("refers_to")).distinct(), "revisits")
    return rows.withColumn("digest", F.sha1("payload")).join(revisits, F.expr("page_id <=> r_page and digest = r_digest"), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 1 << 30) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``path`` and return the manifest ``path, bytes, records``.

    Each attempt of a task writes files of its own names and only the manifest names files, so a repeated task leaves no
    record twice.
    """
    spark = pages.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(path)
        files.create_dir(base, recursive=True)
        part, number, out, name, size, n = TaskContext.get().partitionId(), 0, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{path}/part-{part:05d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    _, local = _filesystem(name)
                    out = files.open_output_stream(local, compression=None)
                    head = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{part}-{number}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                    size, n, number = len(head), 0, number + 1
                record = page_record(page_id, url, payload, refers_to, date)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(with_revisits(pages, min_revisit_bytes).mapInArrow(write, "path string, bytes long, records long"), "manifest")


class _Window:
    """Bytes of a file by position, a block at a time."""

    def __init__(self, file, size: int, block: int = 1 << 20) -> None:
        self.file, self.size, self.block = file, size, block
        self.start, self.data = 0, b""

    def at(self, position: int) -> bytes:
        """The bytes from ``position`` to the end of its block; empty at the file's end."""
        if not self.start <= position < self.start + len(self.data):
            self.start = position
            self.file.seek(position)
            self.data = self.file.read(min(self.block, max(0, self.size - position)))
        return self.data[position - self.start :]

    def find(self, what: bytes, position: int, limit: int) -> int:
        """Where ``what`` starts next in [position, limit), or -1."""
        while position < limit:
            data = self.at(position)
            if len(data) < len(what):
                self.start, self.data = 0, b""
                data = self.at(position)
                if len(data) < len(what):
                    return -1
            k = data.find(what)
            if k >= 0:
                return position + k if position + k < limit else -1
            position += len(data) - len(what) + 1
        return -1

    def inflate(self, position: int) -> tuple[bytes, int] | None:
        """The member at ``position`` and where it ends; None if it isn't a whole WARC record."""
        inflater, out, seen = zlib.decompressobj(31), [], b""
        try:
            while not inflater.eof:
                data = self.at(position)
                if not data:
                    return None
                got = inflater.decompress(data)
                position += len(data) - len(inflater.unused_data)
                out.append(got)
                if len(seen) < len(VERSION):
                    seen += got[: len(VERSION)]
                    if not seen.startswith(b"WARC/"[: len(seen)]):
                        return None
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, position) if whole.startswith(b"WARC/1.") and b"\r\n\r\n" in whole else None


def members(file, size: int, start: int, end: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Records that start in [start, end) of an archive."""
    window, position, chained = _Window(file, size, block), start, False
    while position < end:
        found = window.find(MAGIC, position, end)
        if found < 0:
            return
        got = window.inflate(found)
        if got and not (chained and found == position) and got[1] < size:
            ahead = window.at(got[1])[:3]
            if len(ahead) < 3:
                window.start, window.data = 0, b""
                ahead = window.at(got[1])[:3]
            got = got if ahead == MAGIC else None
        if not got:
            position, chained = found + 1, False
            continue
        yield got[0]
        position, chained = got[1], True


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20, most_tasks: int = 20_000) -> DataFrame:
    """Page records of the manifest's archives, read by byte ranges: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = min(max(1, ranges.count()), most_tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, local = _filesystem(path)
                rows: list[tuple] = []
                with files.open_input_file(local) as file:
                    for record in members(file, size, start, min(size, start + split_bytes)):
                        headers, block = parse(record)
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            length, digest = len(payload), sha1_base32(payload)
                        else:
                            length = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                            digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_page(headers["warc-record-id"]), length, digest, kind, _page(headers.get("warc-refers-to"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return ranges.repartition(n).mapInArrow(read, RECORDS)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS holder FROM p),
d AS (SELECT *, sha1(h) AS x, strlen(h) AS n FROM k)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b: (CAST('0x' || substr(x, 1 + (i * 5 + b) // 4, 1) AS INTEGER) >> (3 - (i * 5 + b) % 4)) % 2 * CAST(2 ** (4 - b) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM d"""
