"""Quality rules with DataFrame functions only: repetition counts and divergence from language references.

A language's reference is a histogram of character classes and one of its most common words, both summed over all
documents of that language. A document is compared with its language's reference by Jensen-Shannon distance (base
2, so from 0 to 1). Short documents have noisy histograms: below ``min_words`` words, and for languages whose
reference has less than ``min_reference_words`` words, the divergence gives no verdict.

Defined results: null and empty texts have no words and fail the base rule; a null language has no reference;
repeated rows are judged each; an empty table gives no rows; other columns are ignored. Repeated windows and common words are told
by 64-bit hashes; of words with equal counts the one with the smaller hash is the more common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.staging import staged

SPACES = r"[\x20\x09-\x0D]+"
CLASSES = ("lower", "space", "upper", "digit", "sign", "other")
N_COMMON = 16


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def window_hashes(words: Column, n: int = 5) -> Column:
    """A hash of each window of ``n`` words, in order."""
    starts = F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - (n - 1)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that occur twice or more, by the windows' ``hashes``. A column given by name is quickest here."""
    none = F.lit(0).cast("long")
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(r: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(r, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    start = F.struct(none.alias("total"), none.alias("end"))
    step = lambda s, p: F.struct((s["total"] + p + n - F.greatest(s["end"], p.cast("long"))).alias("total"), (p + n).cast("long").alias("end"))
    covered = F.aggregate(let(ranked, places), start, step, lambda s: s["total"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(covered)


def sign_counts(text: Column) -> Column:
    """struct of ``symbols`` (characters of ``[#*$%&|<>]``) and ``upper, digit, sign, other, lower_or_space`` characters.

    The classes are disjoint and cover all code points; ``other`` has letters without case, among others. Lower case and white space
    go first, in one pass; the rest is short in most texts. ASCII texts take the same classes by their ASCII members.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    rest = F.when(ascii_only, F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")).otherwise(F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", ""))
    count = lambda r, pattern: F.regexp_count(r, F.lit(pattern)).cast("long")

    def counted(r: Column) -> Column:
        upper, digit, sign = count(r, r"\p{Lu}"), count(r, r"\p{N}"), count(r, r"[\p{P}\p{S}]")
        made = let(F.array(upper, digit, sign), lambda n: F.concat(n, F.array(F.length(r) - n[0] - n[1] - n[2])))
        return F.struct(count(r, r"[#*$%&|<>]").alias("symbols"), made.alias("classes"), (F.length(text) - F.length(r)).cast("long").alias("lower_or_space"))

    return let(rest, counted)


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; without any, all are 0."""
    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the square root of the divergence in bits."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Per row: ``keep``, ``own_lang``, the counts, ``classes`` and ``words``. One pass over the texts."""
    text = F.col("own_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = F.transform(
        F.array(words_of(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            window_hashes(w).alias("windows"),
            w.alias("words"),
        ),
    )
    rows = docs.select(*keep, F.col("lang").alias("own_lang"), F.coalesce("text", F.lit("")).alias("own_text"))
    rows = rows.select(*keep, "own_lang", "own_text", sign_counts(text).alias("signs"))
    space = F.length(text).cast("long") - F.col("word_chars")
    signs = F.col("signs")
    return rows.select(*keep, "own_lang", "own_text", "signs", F.inline(by_words)).select(
        *keep,
        "own_lang",
        "n_words",
        "word_chars",
        signs["symbols"].alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.concat(F.array(signs["lower_or_space"] - space, space), signs["classes"]).alias("classes"),
        "words",
    )


def references(found: DataFrame, min_reference_words: int = 20_000) -> DataFrame:
    """Per language: ``ref_lang, ref_classes, ref_common, common`` (hashes of words) over all documents, from their features."""
    rows = found.where("own_lang is not null")
    sums = rows.groupBy("own_lang").agg(F.sum("n_words").alias("n_words"), *(F.sum(F.get("classes", F.lit(k))).alias(name) for k, name in enumerate(CLASSES)))
    # Words are counted by hash: rows of fixed size make a faster count and a smaller shuffle.
    counted = rows.select("own_lang", F.explode("words").alias("word")).groupBy("own_lang", F.xxhash64("word").alias("word")).count()
    order = Window.partitionBy("own_lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= N_COMMON)
    common = top.groupBy("own_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    none = F.array().cast("array<struct<rank:int,word:bigint,count:bigint>>")
    top_counts = F.transform("top", lambda x: x["count"])
    in_top = F.aggregate(top_counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return sums.where(F.col("n_words") >= min_reference_words).join(common, "own_lang", "left").withColumn("top", F.coalesce("top", none)).select(
        F.col("own_lang").alias("ref_lang"),
        shares(F.array(*(F.col(k).cast("double") for k in CLASSES))).alias("ref_classes"),
        shares(F.transform(F.concat(top_counts, F.array(F.col("n_words") - in_top)), lambda x: x.cast("double"))).alias("ref_common"),
        F.transform("top", lambda x: x["word"]).alias("common"),
    )


def judge(docs: DataFrame, min_words: int = 50, most_class_distance: float = 0.26, most_common_distance: float = 0.40, min_reference_words: int = 20_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, common_distance``."""
    found = staged(features(docs, keep), "features")
    refs = staged(references(found, min_reference_words), "references")
    # A word whose cell of 64 has no common word is passed over; the hashes of the others are compared one by one.
    cell = lambda h: h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    cells = F.aggregate("common", F.lit(0).cast("bigint"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), cell(h))))
    refs = refs.withColumn("cells", cells)
    seen = F.filter(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.call_function("shiftright", F.col("cells"), cell(h)).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    each = let(seen, lambda s: F.transform("common", lambda c: F.size(s) - F.size(F.array_remove(s, c))))
    each = let(each, lambda n: F.concat(n, F.array(F.col("n_words").cast("int") - F.aggregate(n, F.lit(0), lambda a, x: a + x))))
    measured = F.col("ref_lang").isNotNull() & (F.col("n_words") >= min_words)
    far = F.coalesce(F.col("class_distance") > most_class_distance, F.lit(False)) | F.coalesce(F.col("common_distance") > most_common_distance, F.lit(False))
    doubles = lambda counts: F.transform(counts, lambda x: x.cast("double"))
    return (
        found.join(refs, F.col("own_lang") == F.col("ref_lang"), "left")
        .withColumn("class_distance", F.when(measured, js_distance(shares(doubles("classes")), F.col("ref_classes"))))
        .withColumn("common_distance", F.when(measured, js_distance(shares(doubles(each)), F.col("ref_common"))))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")
    )
