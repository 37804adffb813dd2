"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id and sorted, so the part files in name order hold ascending ids. Each
row keeps its document's ids as ``array<int>`` (ORC's run-length encoding), and next to them what readers
need without the ids: their number, the part that wrote them and the ids before them in the part. The
part's totals are the only thing gathered to give each document its global start.

Defined results: a null text is an empty one and gets the end id alone; null ids sort first; repeated rows are kept
and follow each other; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.staging import bounded_batches, give_back

SCHEMA = "doc_id long, n_tokens int, part int, start_in_part long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 8 << 20, index_stride: int = 1000) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file and write ids to ORC below ``path``.

    Stripes are small, so that a file has several: they are what parallel readers take and what lookups skip, and a writer holds one.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quernstone.llm.lexicon import encoder

        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            flat, n = coder.encode(texts, end_id)
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(before + offsets[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_tokens", "part", "start_in_part", "ids"])
            before += int(offsets[-1])
        give_back()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", index_stride)
        .option("orc.stripe.size", stripe_bytes).option("orc.rows.between.memory.checks", 200).option("orc.compress", "ZSTD").orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on ``doc_id`` prune files, stripes and row groups by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    bounded_batches(spark)
    files = read_token_orc(spark, path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            raw = np.asarray(ids.flatten()).astype("<u4", copy=False).data.cast("B")
            at = (np.asarray(ids.offsets).astype(np.int64) - ids.offsets[0].as_py()) * 4
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at) // 4), pa.array(crc)], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # one row for each written file: bounded by the number of write tasks
    return rows.join(F.broadcast(bases), rows.part == bases.base_part).select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
