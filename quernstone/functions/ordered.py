"""Global order without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import materialised


def with_prefix_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``before_<value>``: the sum of each value over all rows that come before in ``order``.

    Rows are range-partitioned; each partition is summed up on its own and only the partitions' totals are ordered in one task.
    ``order`` should identify rows, or ties come in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialised(ranged, "ordered")
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_part"), *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{v}") for v in values))
    # one row for each range partition
    return summed.join(F.broadcast(bases), "_part").select(*df.columns, *((F.col(f"_i_{v}") + F.col(f"_b_{v}")).alias(f"before_{v}") for v in values))


def with_dense_ids(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Adds ``name``: consecutive numbers in ``order``, which must identify rows."""
    out = with_prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    return out.withColumn(name, F.col("before__one") + first).drop("_one", "before__one")


def changes(column: pa.Array, before: pa.Array | None) -> pa.Array:
    """Whether each value differs from the one above it; ``before`` has the one above the first. Nulls are equal."""
    above = pa.concat_arrays([before if before is not None else pa.nulls(1, column.type), column[:-1]])
    same = pc.or_(pc.fill_null(pc.equal(column, above), False), pc.and_(pc.is_null(column), pc.is_null(above)))
    return pc.invert(same)


def with_dense_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """The distinct rows of ``df``, with the 1-based dense rank of the non-null string ``by`` over all rows in its place.

    Rows are dealt and sorted once, by ranges of ``by``; each partition is ranked as it streams by, and the number of values in
    the partitions before it is added afterwards. Only one row for each partition is ordered in one task.
    """
    rest = [c for c in df.columns if c != by]
    ranged = df.repartitionByRange(by).sortWithinPartitions(by, *rest).select(by, *rest, F.spark_partition_id().alias("_part"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes(batch.column(0), last and last.column(0))
            row = new
            for i in range(1, len(rest) + 1):
                row = pc.or_(row, changes(batch.column(i), last and last.column(i)))
            ranks = pc.add(pc.cumulative_sum(pc.cast(new, pa.int64())), rank)
            rank, last = ranks[-1].as_py(), batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([ranks, *batch.columns[1:]], ["_rank", *batch.schema.names[1:]]).filter(row)

    schema = ranged.withColumn("_rank", F.lit(0).cast("long")).select("_rank", *rest, "_part").schema
    ranks = materialised(ranged.mapInArrow(ranked, schema), "ranked")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranks.groupBy("_part").agg(F.max("_rank").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    # one row for each range partition
    return ranks.join(F.broadcast(bases), "_part").select((F.col("_rank") + F.col("_base")).alias(name), *rest)
