"""Binary classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.ordered import with_prefix_sums


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """tn, fp, fn, tp and accuracy, precision, recall, F1 of ``score > threshold``."""
    yes, hit = F.col(label) == 1, F.col(score) > threshold
    n = lambda c: F.count_if(c)
    counts = df.agg(n(~yes & ~hit).alias("tn"), n(~yes & hit).alias("fp"), n(yes & ~hit).alias("fn"), n(yes & hit).alias("tp"))
    return counts.select("*", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids, ties included; scores are ordered by range partitions."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = with_prefix_sums(per, [score], ["neg"])
    return ranked.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.try_divide("area", F.col("p") * F.col("n")).alias("auc"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr`` at each score, rows with at least that score counting as positive; null rates where a class is absent."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = with_prefix_sums(per, [score], ["pos", "neg"])
    totals = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rate = lambda before, total: F.try_divide(F.col(total) - F.col(before), F.col(total))
    return ranked.crossJoin(F.broadcast(totals)).select(F.col(score).alias("threshold"), rate("before_neg", "n").alias("fpr"), rate("before_pos", "p").alias("tpr"))
