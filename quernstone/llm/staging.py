"""Shared-folder staging: how these operators cut lineage and survive lost executors.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` (the
folder that every executor and the driver can reach) and read back, so a lost
executor costs a re-read and never a recomputation of a non-deterministic step.
Once a table is written there, the shuffle files behind it are deleted.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

from quernstone.session import work_dir, written

_C = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None

#: Folders made inside ``in_full``, innermost call last.
_made: list[list[str]] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = work_dir(spark, label)
    if _made:
        _made[-1].append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    path = written(df, label)
    if _made:
        _made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_full(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, computed and staged now, after which all tables that were staged for it are deleted."""
    _made.append([])
    try:
        path = written(make(), label)
    finally:
        for done in _made.pop():
            discard(done, spark)
    if _made:
        _made[-1].append(path)
    return spark.read.parquet(path)


def gathered(df: DataFrame) -> list[Row]:
    """Collect rows whose number and size have a fixed bound. By way of a table, so that the shuffle files behind them go."""
    held = staged(df, "gathered")
    rows = held.collect()
    discard(held, df.sparkSession)
    return rows


def discard(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Delete a staged folder that no later step reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    for p in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """In a Python worker: hand free memory back to the system, since idle workers stay and executors count it."""
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
