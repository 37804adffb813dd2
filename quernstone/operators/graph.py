"""Degrees, neighbourhoods and PageRank over an edge table ``src, dst``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import materialised

LIST = 1024  # targets in a row of PageRank's links, on average at most


def out_degree(edges: DataFrame) -> DataFrame:
    """Edges from each node, repeated ones included; nodes without any are absent."""
    return edges.groupBy("src").agg(F.count("dst").alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("src").alias("in_degree"))


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """Two rows: the node's successors and predecessors as sorted lists."""
    side = lambda name, at, other: edges.where(F.col(at) == node).agg(F.sort_array(F.collect_set(other)).alias("nodes")).select(F.lit(name).alias("side"), F.col("nodes").cast("string").alias("nodes"))
    return side("successors", "src", "dst").unionByName(side("predecessors", "dst", "src"))


def pagerank(edges: DataFrame, rounds: int = 52, damping: float = 0.85, offset: float = 0.15, keep_all: bool = False, cut_every: int = 13) -> DataFrame:
    """``node, rank`` by unnormalised iteration over distinct edges, starting with 1 at every source.

    A node that gets nothing in a round drops out, and its rank with it; with ``keep_all`` it stays at ``offset``.
    Lineage is cut by tables in the shared folder every ``cut_every`` rounds. The edges are kept as lists of some ``LIST`` targets of
    a source, so that a round joins a row for each list and not for each edge; targets are told apart after the join.
    """
    distinct = materialised(edges.select("src", "dst").where("src is not null").distinct(), "pagerank-edges")
    degrees = distinct.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / LIST)).alias("part")
    kind = distinct.schema["dst"].dataType.simpleString()
    no_target = F.when(F.bool_or(F.col("dst").isNull()), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    links = distinct.join(degrees, "src").groupBy("src", "n", part).agg(F.concat(F.collect_list("dst"), no_target).alias("targets")).drop("part")
    links = materialised(links, "pagerank-links")
    everyone = materialised(distinct.select(F.col("src").alias("node")).union(distinct.select("dst")).distinct(), "pagerank-nodes") if keep_all else None
    ranks = links.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        given = links.join(ranks, links.src == ranks.node).select((F.col("rank") / F.col("n")).alias("share"), F.explode("targets").alias("dst")).groupBy("dst").agg(F.sum("share").alias("got"))
        ranks = given.select(F.col("dst").alias("node"), (F.col("got") * damping + offset).alias("rank"))
        if keep_all:
            ranks = everyone.join(ranks, "node", "left").withColumn("rank", F.coalesce("rank", F.lit(offset)))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            ranks = materialised(ranks, "pagerank")
    return ranks
