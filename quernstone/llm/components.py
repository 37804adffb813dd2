"""Connected components of an edge table by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.staging import discard, staged


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges(u, v)`` with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(low, "u")
    return small.where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the component's least node.

    Links stay distributed. Each round is written to the shared folder; rounds end when nothing changes.
    """
    spark = edges.sparkSession
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        after = staged(_round(now), "links")
        mark = digest(after)
        discard(now, spark)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
