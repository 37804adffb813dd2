"""Best-fit packing of tokenised documents into fixed-length sequences.

Each task packs its own documents. Open bins are kept by free space, with a bitset whose bit f says
that a bin with f free tokens is open; the best fit for n tokens is the lowest set bit from n upwards.
At most ``open_bins`` bins are open; beyond that the fullest closes. Memory per task is bounded by that number.

What a task's open bins still hold at its end would leave one tail for each task. These tails are far
fewer than documents: they are packed again, bin by bin, in a second round over fewer tasks.

Defined results: a null text is an empty one (its end id is its only token); repeated rows are packed each;
an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.staging import bounded_batches, give_back, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"
#: Piece number of the rows that tell what a task's open bins hold at its end.
TAIL = -1


class OpenBins:
    """Bounded-space online best fit over bins of ``size`` tokens."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.n_open = 0
        self.next_bin = 0
        self.last_closed: int | None = None

    def put(self, n: int) -> tuple[int, int]:
        """Place an item of ``n`` tokens: its bin and its place there."""
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            stack = self.free[space]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << space
            self.n_open -= 1
        else:
            number, space = self.next_bin, self.size
            self.next_bin += 1
        left = space - n
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                stack = self.free[fullest]
                self.last_closed = stack.pop()
                self.n_open -= 1
                if not stack:
                    self.bits ^= 1 << fullest
        return number, self.size - space

    def still_open(self) -> dict[int, int]:
        """Open bins and their free space."""
        return {number: space for space, stack in enumerate(self.free) for number in stack}


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, with the remainder first."""
    if n <= size:
        return [n]
    return [n % size] * bool(n % size) + [size] * (n // size)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, open_bins: int = 4096) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quernstone.llm.lexicon import encoder

        coder, base = encoder(tokenizer), TaskContext.get().partitionId() << 32
        bins = OpenBins(size, open_bins)

        def rows(*columns: list) -> pa.RecordBatch:
            doc, piece, *longs = columns
            longs[-2] = [base + x for x in longs[-2]]
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in longs)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            flat, n = coder.encode(texts, end_id)
            raw, at = flat.astype("<u4", copy=False).data.cast("B"), 0
            doc, piece, start, length, crc, number, place = ([] for _ in range(7))
            for d, total in zip(batch.column(0).to_pylist(), n.tolist(), strict=True):
                done = 0
                for k, m in enumerate(piece_lengths(total, size)):
                    a, b = bins.put(m)
                    doc.append(d)
                    piece.append(k)
                    start.append(done)
                    length.append(m)
                    crc.append(zlib.crc32(raw[at : at + 4 * m]))
                    number.append(a)
                    place.append(b)
                    done, at = done + m, at + 4 * m
            yield rows(doc, piece, start, length, crc, number, place)
        give_back()
        if tails := bins.still_open():
            k = len(tails)
            yield rows([None] * k, [TAIL] * k, [0] * k, [size - x for x in tails.values()], [0] * k, list(tails), [0] * k)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = (TaskContext.get().partitionId() << 32) + (1 << 62), OpenBins(size, open_bins)
        for batch in batches:
            put = [bins.put(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([base + a for a, _ in put], pa.int64()), pa.array([b for _, b in put], pa.int64())], ["bin", "sequence_id", "shift"])

    packed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first_round, PIECES), "packed")
    tails = packed.where(F.col("piece") == TAIL).select("bin", F.col("length").alias("fill"))
    n_tasks = max(1, -(-tails.count() // 100_000))  # by far fewer than documents; dealt out evenly, largest first
    moved = tails.repartition(n_tasks, F.xxhash64("bin")).sortWithinPartitions(F.desc("fill"), "bin")
    moved = staged(moved.mapInArrow(second_round, "bin long, sequence_id long, shift long"), "tails")
    return (
        packed.where(F.col("piece") != TAIL)
        .join(moved, "bin", "left")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
    )
