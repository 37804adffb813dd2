"""Word counts, co-occurrence and bags of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import STOP_WORDS, clean, clean_strict, tokens, without_stop_words
from quernstone.session import materialised


def tokenized(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words``: cleaned tokens without stop words (empty tokens stay)."""
    return df.withColumn("words", without_stop_words(tokens(clean(F.col(text)))))


def exploded(words: Column) -> Column:
    """An explode whose nulls are to be dropped: Spark filters the input of an inner one first, which evaluates ``words`` twice."""
    return F.explode_outer(words)


def text_word_counts(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """``word_counts`` of ``tokenized`` rows, with stop words dropped after the explode, where the check is compiled code."""
    keys = keys or []
    rows = df.select(*keys, exploded(tokens(clean(F.col(text)))).alias("word")).where(F.col("word").isNotNull() & ~F.col("word").isin(*STOP_WORDS))
    return rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"))


def word_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, word, cnt`` from a ``words`` column. Counts combine before the shuffle."""
    keys = keys or []
    return df.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"))


def top_words(counts: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """The ``n`` most frequent words of each key with their rank; ties by word."""
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cooccurrence(df: DataFrame, key: str, n: int = 100, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``key, w1, w2, cnt``: in how many texts of a key two of its ``n`` top words are found together, both ways round.

    The vocabulary comes from tokens without stop words; texts are split at blanks with them.
    A text contributes pairs of at most ``n`` words. The vocabulary has one row for each key and is written first, so that
    Spark knows its size: below its limit it is broadcast and no text moves, where a shuffle would send all texts of a key to one task.
    """
    vocabulary = top_words(text_word_counts(df, [key], text), [key], n).groupBy(key).agg(F.collect_set("word").alias("vocabulary"))
    here = df.select(key, F.array_distinct(F.split(clean(F.col(text)), " ")).alias("found")).join(materialised(vocabulary, "vocabulary"), key)
    here = here.select(key, F.array_sort(F.array_intersect("found", "vocabulary")).alias("w"))
    first = here.select(key, "w", F.posexplode_outer("w").alias("i", "a"))
    pairs = first.select(key, "a", exploded(F.slice("w", F.col("i") + 2, F.size("w"))).alias("b")).where("b is not null")
    counted = pairs.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    both = F.array(F.struct(F.col("a").alias("w1"), F.col("b").alias("w2")), F.struct(F.col("b").alias("w1"), F.col("a").alias("w2")))
    return counted.select(key, F.inline(both), "cnt")


def bag_of_words(df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 4, min_share: float = 0.01) -> DataFrame:
    """``doc, term, cnt`` of terms that at least ``min_share`` of the documents hold.

    Terms that too few rows hold can't be held by enough documents and are dropped before any pair of document and term moves. The
    others are at most the mean number of terms in a row / ``min_share``, at any size of the table; their documents are
    counted exactly, since several rows may share an id.
    """
    split = F.split(clean_strict(F.col(text)), " ")
    kept = F.col("term").isNotNull() & (F.length("term") >= min_chars) & ~F.col("term").isin(*STOP_WORDS)
    rows = df.agg((min_share * F.count(F.lit(1))).alias("least"))
    enough = lambda held: held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rows)).where("n >= least").select("term")
    perhaps = materialised(enough(df.select(exploded(F.array_distinct(split)).alias("term")).where(kept)), "terms")
    long = df.select(doc, exploded(split).alias("term")).where(kept).join(perhaps, "term", "left_semi")
    long = materialised(long.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("cnt")), "bags")
    return long.join(materialised(enough(long), "terms"), "term", "left_semi").select(doc, "term", "cnt")
