"""Exact substring deduplication with fixed-block anchors.

1. Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words; these are the index.
   Any repeat of ``window`` words contains a whole block of either place.
2. Every rolling window of block length probes the index: hashes meet by bucket, at five bytes a probe. Blocks found in
   two places or more are anchors; they go into a fixed-size bitmap.
3. A second scan extends around the anchors: all ``window``-word windows with an anchor inside, and only they, are counted
   exactly by 64-bit hash, again by bucket. Repeated windows go back to the unit of documents they came from.
4. There the repeated windows' union, which is the maximal repeats, is removed. Documents without an anchor never leave step 3.

A passage that very many documents share meets as one entry for each unit of documents, not for each document.

Defined results: a null text has no words; texts shorter than a window are kept whole; repeated rows are repeats of each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import repeated
from quernstone.llm.staging import bounded_batches, discard, staged
from quernstone.llm.wordhash import hashed_words, windows

_SCAN = "doc_id long, n_words long, kept_sha256 string, kept string, text binary, unit long, bucket int, hashes binary, twice binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words inside windows that start at ``at``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + width, n), 1)
    return np.cumsum(edge[:-1]) > 0


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    return ascending[np.minimum(at, len(ascending) - 1)] == values


def deduplicate(docs: DataFrame, window: int = 35, keep_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, the kept words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    block = (window + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = repeated.bucket_bits(rows)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in repeated.in_units(batches, 1):
            words, cut = hashed_words(texts, False)
            at, h = windows(words, cut, block)
            place = at - np.repeat(cut[:-1], np.diff(cut))[at]
            yield repeated.blobs(h, h[place % block == 0], bits)

    anchors = repeated.repeated_map(rows.mapInArrow(probe, repeated.BLOBS), True, bits)
    shared = spark.sparkContext.broadcast(anchors)  # 16 MB at any input size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for number, (batch, texts) in enumerate(repeated.in_units(batches, 1)):
            unit = task + number
            words, cut = hashed_words(texts, False)
            at, h = windows(words, cut, block)
            hit = np.zeros(len(words) + 1, np.int64)
            hit[at[repeated.passes(shared.value, h)] + 1] = 1
            hits = np.cumsum(hit)
            start, long_hash = windows(words, cut, window)
            near = hits[start + window - block + 1] > hits[start]
            start, long_hash = start[near], long_hash[near]
            inside = np.searchsorted(start, cut)
            touched = inside[1:] > inside[:-1]
            done = [None if touched[i] else _digest(t.split()) for i, t in enumerate(texts)]
            kept = [b" ".join(t.split()).decode() if keep_text and not touched[i] else None for i, t in enumerate(texts)]
            n = len(texts)
            blank = lambda kind, n=n: pa.nulls(n, kind)
            names = [x.split()[0] for x in _SCAN.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut)), pa.array(done, pa.string()), pa.array(kept, pa.string()), pa.array([t if touched[i] else None for i, t in enumerate(texts)], pa.binary()), pa.array(np.full(n, unit)), blank(pa.int32()), blank(pa.binary()), blank(pa.binary())], names)
            if len(long_hash):
                found, count = np.unique(long_hash, return_counts=True)
                numbers, parts = repeated.split_by_bucket(found, bits)
                again = dict(zip(*repeated.split_by_bucket(found[count > 1], bits), strict=True))
                m = len(numbers)
                blank = lambda kind, m=m: pa.nulls(m, kind)
                lists = [[x.astype("<u8").tobytes() for x in parts], [again[k].astype("<u8").tobytes() if k in again else b"" for k in numbers]]
                yield pa.RecordBatch.from_arrays([blank(pa.int64()), blank(pa.int64()), blank(pa.string()), blank(pa.string()), blank(pa.binary()), pa.array(np.full(m, unit)), pa.array(numbers, pa.int32()), *(pa.array(x, pa.binary()) for x in lists)], names)

    scanned = staged(rows.mapInArrow(scan, _SCAN), "anchored")

    def meet(group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()]
        every = np.sort(np.concatenate(sent))
        again = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([np.frombuffer(x, "<u8") for x in group.column("twice").to_pylist()]))
        back = [x[_among(x, again)] for x in sent]
        return pa.table({"unit": group.column("unit"), "hashes": pa.array([x.tobytes() for x in back], pa.binary())})

    sent = scanned.where("bucket is not null").select("bucket", "unit", "hashes", "twice")
    found = staged(sent.groupBy("bucket").applyInArrow(meet, "unit long, hashes binary").where("length(hashes) > 0"), "found")

    def cut_out(key: tuple, texts: pa.Table, hashes: pa.Table) -> pa.Table:
        again = np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in hashes.column("hashes").to_pylist())]))
        out: list[list] = [[] for _ in range(5)]
        for doc, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            hashed, cut = hashed_words([text], False)
            at, h = windows(hashed, cut, window)
            gone = _covered(at[_among(h, again)], len(hashed), window)
            left = [w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g]
            for column, value in zip(out, (doc, len(hashed), int(gone.sum()), _digest(left), b" ".join(left).decode() if keep_text else None), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    touched = scanned.where("bucket is null and text is not null").select("unit", "doc_id", "text")
    changed = touched.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(cut_out, RESULT)
    whole = scanned.where("bucket is null and text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept")
    out = whole.unionByName(changed)
    return out if keep_text else out.drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, k, hash(w[k:k + 34]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, k FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(k, k + 35)) AS p FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""
