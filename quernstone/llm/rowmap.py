"""A bitmap of keys, of fixed size, that tells rows which can be among few others from those which cannot.

Rows that the bitmap passes are then joined exactly; the others take part in no join, so large rows are not shuffled for the
sake of few. The bitmap has no false negatives and is no answer by itself. It has 2**26 bits in 64-bit words, at most 2**20
rows of two longs, at any size of the tables; with some 30 million keys it passes a third of all others, with more it
thins less, and results stay right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 26


def _slot(key: str) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << _BITS) - 1))


def _place(key: str) -> Column:
    return _slot(key).bitwiseAND(F.lit(63)).cast("int")


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """``slot_word, slots``: the bitmap of a column."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(key))
    return keys.select(F.shiftright(_slot(key), 6).alias("slot_word"), bit.alias("bit")).groupBy("slot_word").agg(F.bit_or("bit").alias("slots"))


def perhaps_in(df: DataFrame, bitmap: DataFrame, key: str) -> DataFrame:
    """``df`` with ``perhaps``: whether its ``key`` can be among the bitmap's. Nothing is shuffled."""
    met = df.join(F.broadcast(bitmap), F.shiftright(_slot(key), 6) == F.col("slot_word"), "left")  # at most 2**20 rows
    bit = F.call_function("shiftright", F.col("slots"), _place(key)).bitwiseAND(F.lit(1))
    return met.withColumn("perhaps", F.coalesce(bit == 1, F.lit(False))).drop("slot_word", "slots")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among those of the table ``keys``; null keys stay."""
    told = perhaps_in(df, bitmap_of(keys, key), key)
    return told.where("not perhaps").drop("perhaps").unionByName(told.where("perhaps").drop("perhaps").join(keys.select(key).hint("merge"), key, "left_anti"))
