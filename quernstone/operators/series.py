"""Fixed-slot averages over wide and long time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.ordered import with_prefix_sums


def wide_slices(events: DataFrame, key: str, start: str, slices: int = 144, minutes: int = 20, ts: str = "ts", value: str = "value") -> DataFrame:
    """One row for each key with ``TS1 .. TSn``: the value's sum in each slice after ``start``, 0 where there is none."""
    number = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / (minutes * 60_000_000)) + 1
    inside = events.withColumn("_slice", number.cast("int")).where(F.col("_slice").between(1, slices))
    wide = inside.groupBy(key).pivot("_slice", list(range(1, slices + 1))).agg(F.sum(value))
    return wide.select(key, *(F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"TS{i}") for i in range(1, slices + 1)))


def slot_averages(wide: DataFrame, size: int, slices: int = 144) -> DataFrame:
    """Means of ``size`` neighbouring slices as ``slot0 ..``; other columns stay. A null slice makes its slot null."""
    names = [f"TS{i}" for i in range(1, slices + 1)]
    slots = {f"slot{k}": sum((F.col(c) for c in names[k * size + 1 : (k + 1) * size]), F.col(names[k * size])) / size for k in range(slices // size)}
    return wide.select(*(c for c in wide.columns if c not in names), *(x.alias(k) for k, x in slots.items()))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, q1, q2, q3``: exact quartiles with linear interpolation, by range-partitioned ranks.

    No group is held in one task. Null values do not count; groups without any are absent.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_same"))
    ranked = with_prefix_sums(rows, [*keys, "_v"], ["_same"])
    groups = ranked.groupBy(*keys).agg(F.sum("_same").alias("n"), F.min("before__same").alias("_first"))
    wanted = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), (F.lit(q) * 0.25 * (F.col("n") - 1)).alias("at")) for q in (1, 2, 3)))).alias("w")
    asked = groups.select(*(F.col(k).alias(f"_g_{k}") for k in keys), "n", "_first", wanted).select("*", "w.q", "w.at").drop("w")
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    here = lambda at: (F.col("_first") + at >= F.col("before__same")) & (F.col("_first") + at < F.col("before__same") + F.col("_same"))
    met = ranked.join(asked, [*same, here(F.floor("at")) | here(F.ceil("at"))])
    low, high = F.max(F.when(here(F.floor("at")), F.col("_v"))), F.max(F.when(here(F.ceil("at")), F.col("_v")))
    found = met.groupBy(*keys, "n", "q", "at").agg(low.alias("low"), high.alias("high"))
    found = found.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    return found.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("q") == q, F.col("x"))).alias(f"q{q}") for q in (1, 2, 3)))


def by_hour(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Per hour of day: count and quartiles of the logarithm of positive values."""
    return quartiles(events.where(F.col(value) > 0).select(F.hour(ts).alias("hour"), F.log(value).alias("value")), ["hour"], "value")


def earliest(events: DataFrame, n: int, tie: str, ts: str = "ts") -> DataFrame:
    """The ``n`` first rows by event time, ties by ``tie``."""
    return events.orderBy(ts, tie).limit(n)


def per_day(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows per day and key."""
    return events.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.count(F.lit(1)).alias("cnt"))


def popularity(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Average positive value by hour and weekday."""
    return events.where(F.col(value) > 0).groupBy(F.hour(ts).alias("hour"), F.date_format(ts, "EEEE").alias("weekday")).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
