"""Neighbourhood recommendation on sparse ratings ``user, item, rating``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_rated(ratings: DataFrame) -> DataFrame:
    """Mean rating of each item."""
    return ratings.groupBy("item").agg(F.avg("rating").alias("avg_rating"))


def _centred(ratings: DataFrame, by: str) -> DataFrame:
    """Ratings minus the mean of their user or item. Absent ratings count as 0 and need no rows."""
    return ratings.withColumn("x", F.col("rating") - F.avg("rating").over(Window.partitionBy(by)))


def _cosines(centred: DataFrame, by: str, across: str, target: Column) -> DataFrame:
    """``by, similarity`` to the target; undefined where a norm is 0."""
    norms = centred.groupBy(by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    own = centred.where(target).select(across, F.col("x").alias("y"))
    own_norm = own.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("own_norm"))
    dots = centred.join(own, across, "left").groupBy(by).agg(F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("dot"))
    scored = dots.join(norms, by).crossJoin(F.broadcast(own_norm)).where("norm > 1e-9 and own_norm > 1e-9")
    return scored.select(by, (F.col("dot") / (F.col("norm") * F.col("own_norm"))).alias("similarity"))


def similar_users(ratings: DataFrame, user: int, k: int = 100) -> DataFrame:
    """The ``k`` users most like ``user`` by cosine of centred ratings, without the user."""
    found = _cosines(_centred(ratings, "user"), "user", "item", F.col("user") == user)
    return found.where(F.col("user") != user).withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "user").limit(k)


def similar_items(ratings: DataFrame, item: int, user: int, k: int = 20) -> DataFrame:
    """The ``k`` items most like ``item`` among those that ``user`` has rated (itself included if rated)."""
    rated = ratings.where(F.col("user") == user).select("item").distinct()
    found = _cosines(_centred(ratings, "item"), "item", "user", F.col("item") == item)
    return found.join(rated, "item", "left_semi").withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "item").limit(k)


def user_predictions(ratings: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Per item: similarity-weighted sum over neighbours who rated it, divided by the sum over *all* neighbours."""
    total = neighbours.agg(F.sum("similarity").alias("total"))
    met = ratings.join(neighbours, "user").groupBy("item").agg(F.sum(F.col("similarity") * F.col("rating")).alias("got"))
    return met.crossJoin(F.broadcast(total)).select("item", F.try_divide("got", "total").alias("prediction"))


def item_predictions(ratings: DataFrame, user: int, n_targets: int = 10, k: int = 20) -> DataFrame:
    """Predictions for the first ``n_targets`` items that ``user`` has not rated, all targets in one plan.

    Each is the similarity-weighted mean of the user's ratings over the ``k`` most similar items that the user rated.
    """
    mine = ratings.where(F.col("user") == user).select("item", F.col("rating").alias("own"))
    targets = ratings.select("item").distinct().join(mine, "item", "left_anti").orderBy("item").limit(n_targets).withColumnRenamed("item", "target")
    centred = _centred(ratings, "item")
    norms = centred.groupBy("item").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 1e-9")
    left = centred.join(F.broadcast(targets), F.col("item") == F.col("target")).select("target", "user", F.col("x").alias("y"))  # n_targets rows
    right = centred.join(mine, "item")
    dots = left.join(right, "user").groupBy("target", "item").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = F.broadcast(targets).crossJoin(mine).join(dots, ["target", "item"], "left")
    scored = pairs.join(norms, "item").join(norms.select(F.col("item").alias("target"), F.col("norm").alias("own_norm")), "target")
    scored = scored.withColumn("similarity", F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("own_norm")), 6))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("similarity"), "item"))).where(F.col("rank") <= k)
    return best.groupBy(F.col("target").alias("item")).agg(F.sum(F.col("similarity") * F.col("own")).alias("got"), F.sum("similarity").alias("total")).select("item", F.try_divide("got", F.when(F.abs("total") > 1e-9, F.col("total"))).alias("prediction"))
