"""Column profiles, imputation, scaling and categorical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """``df`` with global aggregates as columns: one aggregate row, broadcast to all rows."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in scalars.items()))))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, after mean imputation: ``column_name, count, min, max, mean, std``; one pass over the data.

    With n values of which m are present, filling by the mean leaves min, max and mean as they are, and scales the sample
    variance by (m - 1) / (n - 1).
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.count), ("lo", F.min), ("hi", F.max), ("avg", F.avg), ("var", F.var_samp))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("count"), F.col(f"lo_{i}").alias("min"), F.col(f"hi_{i}").alias("max"), F.col(f"avg_{i}").alias("mean"), F.sqrt(F.try_divide(F.col(f"var_{i}") * (F.col(f"m_{i}") - 1), F.col("n") - 1)).alias("std")) for i, c in enumerate(columns)))
    return stats.select(F.inline(rows))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls by the column's mean, as double."""
    out = _with_scalars(df, **{f"_avg_{i}": F.avg(c) for i, c in enumerate(columns)})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_avg_{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def minmax_normalize(df: DataFrame, columns: list[str], prefix: str = "norm_") -> DataFrame:
    """Adds columns scaled to [0, 1]; a constant column becomes 0.5."""
    out = _with_scalars(df, **{f"_lo_{i}": F.min(c) for i, c in enumerate(columns)}, **{f"_hi_{i}": F.max(c) for i, c in enumerate(columns)})
    scaled = {f"{prefix}{c}": F.when(F.col(f"_hi_{i}") > F.col(f"_lo_{i}"), F.try_divide(F.col(c) - F.col(f"_lo_{i}"), F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))).when(F.col(c).isNotNull(), 0.5) for i, c in enumerate(columns)}
    return out.withColumns(scaled).select(*df.columns, *scaled)


def standardize(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Adds (x - mean) / population deviation; nulls and constant columns become 0."""
    out = _with_scalars(df, **{f"_avg_{i}": F.avg(c) for i, c in enumerate(columns)}, **{f"_sd_{i}": F.stddev_pop(c) for i, c in enumerate(columns)})
    scaled = {f"{prefix}{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_avg_{i}"), F.col(f"_sd_{i}")), F.lit(0.0)) for i, c in enumerate(columns)}
    return out.withColumns(scaled).select(*df.columns, *scaled)


def null_nan_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: ``column_name, nulls, nans, null_percent, distinct_values``."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *(x for i, c in enumerate(columns) for x in (F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"nans_{i}"), F.count_distinct(c).alias(f"d_{i}"))))
    return stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{i}").alias("nulls"), F.col(f"nans_{i}").alias("nans"), (F.round(F.try_divide(F.col(f"nulls_{i}"), F.col("n")), 4) * 100).alias("null_percent"), F.col(f"d_{i}").alias("distinct_values")) for i, c in enumerate(columns)))))


def frequent_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n - 1`` most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n - 1).select(column)


def fold_categories(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Adds ``name``: the value if it is one of the ``n - 1`` most frequent, else 'other' (nulls too)."""
    top = frequent_categories(df, column, n).withColumnRenamed(column, "_top")
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(name, F.coalesce("_top", F.lit("other"))).drop("_top")  # n - 1 rows


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Adds a 0/1 column for each of the fixed categories."""
    return df.withColumns({f"{column}_{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in categories})


def log_skewed(df: DataFrame, column: str, name: str, most: float = 1.0) -> DataFrame:
    """Adds log10(x + 1 - min(0, min x)) if the bias-corrected skewness is over ``most``, else x."""
    n, g = F.count(column), F.skewness(column)
    corrected = F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))
    out = _with_scalars(df, _skew=corrected, _low=F.least(F.lit(0.0), F.min(column)))
    return out.withColumn(name, F.when(F.col("_skew") > most, F.log10(F.col(column) + 1 - F.col("_low"))).otherwise(F.col(column))).drop("_skew", "_low")


def hash_split(df: DataFrame, key: str, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """A reproducible split by the key's hash."""
    part = F.pmod(F.xxhash64(key), F.lit(100))
    return df.where(part < percent), df.where(part >= percent)


def labels_share(df: DataFrame, label: str) -> DataFrame:
    """Rows of each label and the positive share in percent."""
    return df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("negatives"), (F.avg(label) * 100).alias("positive_percent"))


def compose(df: DataFrame, *steps) -> DataFrame:
    """Apply feature steps one after the other."""
    for step in steps:
        df = step(df)
    return df


def score(df: DataFrame, scorer, name: str = "score") -> DataFrame:
    """Adds ``name`` by a pluggable scorer: a callable that gives a column (an expression or a pandas UDF)."""
    return df.withColumn(name, scorer(df))
