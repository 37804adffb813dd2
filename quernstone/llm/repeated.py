"""Which 64-bit values occur in more than one place, over all data, at a few bytes a value.

Each unit of work (a bounded run of a task's rows) sends, for each bucket of the value range, one blob of its distinct
sorted values. A bucket's blobs meet in one group. The number of buckets follows from the size of the input, so that a group
keeps its size; where one exchange would need more buckets than a unit can fill, a second one splits them further.
The repeated values go into a bitmap of fixed size. It is a filter and no answer: it has no false negatives, and whoever uses it
counts exactly what passes. From some 0.3 billion repeated values on most of its bits are set and it thins little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.staging import gathered, give_back

#: Buckets are runs of the value range; there are at least 2**8, and one exchange has at most 2**14.
LEAST_BITS, MOST_BITS = 8, 14
#: What one bucket should hold.
BUCKET_BYTES = 16 << 20
#: The bitmap's fixed size: 2**27 bits are 16 MB.
MAP_BITS = 27
BLOBS = "bucket int, seen binary, twice binary, chosen binary"


def bucket_bits(texts: DataFrame) -> int:
    """The logarithm of the number of buckets, from the bytes of all texts (a value for each word, of about as many bytes)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(28, max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()))


def _pack(values: np.ndarray) -> bytes:
    """Bits 16 to 55 of values: four bytes and one byte each. The top 8 bits follow from the bucket."""
    low = values >> np.uint64(16)
    return (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((low >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def split_by_bucket(values: np.ndarray, bits: int) -> tuple[list[int], list[np.ndarray]]:
    """Sorted values cut by their top ``bits``: numbers of the buckets that have any, and their values."""
    top = (values >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(top, prepend=-1))
    return top[first].tolist(), np.split(values, first[1:]) if len(first) else []


def _batch(seen: np.ndarray, twice: np.ndarray, chosen: np.ndarray, bits: int) -> pa.RecordBatch:
    """Blobs of sorted distinct values by bucket; ``twice`` and ``chosen`` are among ``seen``."""
    numbers, parts = split_by_bucket(seen, bits)
    columns = [[_pack(x) for x in parts]]
    for some in (twice, chosen):
        held = dict(zip(*split_by_bucket(some, bits), strict=True))
        columns.append([_pack(held[k]) if k in held else b"" for k in numbers])
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["bucket", "seen", "twice", "chosen"])


def blobs(values: np.ndarray, chosen: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """A unit's blobs. ``chosen``: values of which one must be among the repeated (None: all)."""
    cut = np.uint64(16)
    values = np.sort(values >> cut << cut)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    seen = values[fresh]
    picked = np.unique(chosen >> cut << cut) if chosen is not None else seen[:0]
    return _batch(seen, np.unique(values[~fresh]), picked, min(bits, MOST_BITS))


def _whole(bucket: int, bits: int, blob: bytes) -> np.ndarray:
    return _unpack(blob) << np.uint64(16) | np.uint64(bucket >> (bits - 8)) << np.uint64(56)


def _split_further(sent: DataFrame, bits: int) -> DataFrame:
    """The second exchange's input: blobs by 2**MOST_BITS buckets, merged a portion at a time and cut by ``bits``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = -1, ([], [], []), 0

        def flush() -> pa.RecordBatch:
            seen, twice, chosen = (np.sort(np.concatenate(x)) for x in held)
            again = np.union1d(seen[1:][seen[1:] == seen[:-1]], twice)
            return _batch(np.unique(seen), again, np.unique(chosen), bits)

        for batch in batches:
            for number, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size and (number != bucket or size > 64 << 20):
                    yield flush()
                    held, size = ([], [], []), 0
                bucket = number
                for column, blob in zip(held, parts, strict=True):
                    column.append(_whole(number, MOST_BITS, blob))
                    size += len(blob)
        if size:
            yield flush()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(split, BLOBS)


def repeated_map(sent: DataFrame, choose: bool, bits: int) -> np.ndarray:
    """The bitmap (as bytes) of values that occur twice or more and, with ``choose``, are chosen somewhere."""

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        take = lambda name: np.concatenate([_whole(bucket, bits, x) for x in group.column(name).to_pylist()])
        seen = np.sort(take("seen"))
        again = np.union1d(seen[1:][seen[1:] == seen[:-1]], take("twice"))
        if choose:
            again = again[np.isin(again, take("chosen"))]
        return _segment(again, bucket >> (bits - LEAST_BITS))

    if bits > MOST_BITS:
        sent = _split_further(sent, bits)
    return _assembled(sent.groupBy("bucket").applyInArrow(meet, "part int, bits binary"))


def value_map(values: DataFrame, column: str) -> np.ndarray:
    """The bitmap of all values of a long column."""
    place = F.shiftrightunsigned(column, 64 - MAP_BITS)
    word = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = values.select(F.shiftright(place, 6).alias("at"), word.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        words = np.zeros(1 << (MAP_BITS - LEAST_BITS - 6), "<u8")
        words[np.asarray(group.column("at")) & (len(words) - 1)] = np.asarray(group.column("bits")).view(np.uint64)
        packed = np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little")).tobytes()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(packed, 1)], pa.binary())})

    parts = rows.withColumn("part", F.shiftright("at", MAP_BITS - LEAST_BITS - 6).cast("int"))
    return _assembled(parts.groupBy("part").applyInArrow(pack, "part int, bits binary"))


def _segment(values: np.ndarray, part: int) -> pa.Table:
    """One of the 2**8 parts of the bitmap, with the bits of these values of it."""
    bits = np.zeros(1 << (MAP_BITS - LEAST_BITS), bool)
    bits[(values << np.uint64(LEAST_BITS) >> np.uint64(64 - MAP_BITS + LEAST_BITS)).astype(np.int64)] = True
    return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})


def _assembled(parts: DataFrame) -> np.ndarray:
    """The parts put together; pieces of one part are united on the executors, so that the driver gets each part once."""

    def unite(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros(1 << (MAP_BITS - LEAST_BITS - 3), np.uint8)
        for x in group.column("bits").to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    size = 1 << (MAP_BITS - LEAST_BITS - 3)
    out = np.zeros(size << LEAST_BITS, np.uint8)
    for row in gathered(parts.groupBy("part").applyInArrow(unite, "part int, bits binary")):  # fixed size: the bitmap
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values >> np.uint64(64 - MAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) > 0


def in_units(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches gathered into units of about ``most_bytes`` of text, with their texts as bytes (null: empty)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes:
            yield _unit(held, column)
            held, size = [], 0
            give_back()
    if held:
        yield _unit(held, column)
    held = []
    give_back()


def _unit(held: list[pa.RecordBatch], column: int) -> tuple[pa.RecordBatch, list[bytes]]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()
    batch = whole[0] if whole else held[0]
    return batch, [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


