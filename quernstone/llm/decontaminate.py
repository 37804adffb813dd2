"""Benchmark decontamination with a positional inverted index, DataFrame functions only.

1. *Index.* Documents get a row key, fixed by staging. The postings (row, term, position) of all terms that the benchmark has are
   stored; all later steps read them and never the texts.
2. *Rarest terms first.* Each window of ten item words has as anchors its two rarest terms. Minus its place in the item, an
   anchor's posting names a diagonal of a row; the offset-adjusted lists of two anchors meet on one diagonal of a row if the
   window occurs there.
3. *All terms.* On each diagonal where two anchors meet, the lists of all the item's terms are intersected: the postings of those rows
   are joined with the places that the item's words have there, and up to ``slack`` words off.
4. Places that agree on the diagonal itself in runs of a window are exact phrase matches. Windows of which ``near`` words agree on it
   or within ``slack`` words of it (a changed, a missing or an added word) are proximity matches; by definition these have two
   anchors of the item at their distance.

Rows without a meeting diagonal are told by a bitmap of fixed size and take part in no join, so neither whole texts nor
the postings of clean rows are shuffled, at any size of the table.

Defined results: null texts have no words; items without words have no window; rows are judged each, also if ids repeat or are
null; repeated benchmark rows are one item, and texts that share an item id are each looked for; an item with a null id hits like
others and is a null in ``items``; an empty benchmark hits nothing, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.quality import let
from quernstone.llm.rowmap import bitmap_of, perhaps_in
from quernstone.llm.staging import discard, staged

#: All that is not part of a word, before and after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words of a text, case as it stands."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def fold(word: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UP, _LOW))


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_words`` of items with words; equal ones once."""
    return benchmark.select("item_id", F.transform(split_words(F.col("text")), fold).alias("item_words")).where("size(item_words) > 0").distinct()


def anchors_of(passages: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """``term, passage, place``: the two rarest terms of each window. Terms that no document has cannot be anchors."""
    placed = passages.select("passage", F.posexplode("terms").alias("place", "term")).join(frequency, "term", "left")
    known = placed.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("place", "df", "term"))).alias("known"))

    def of(k: Column, start: Column, span: Column) -> Column:
        inside = F.filter(F.slice(k, start + 1, span), lambda x: x["df"].isNotNull())
        return F.slice(F.array_sort(F.transform(inside, lambda x: F.struct(x["df"].alias("df"), x["place"].alias("place"), x["term"].alias("term")))), 1, 2)

    span = F.least(F.lit(window), F.size("known"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("known") - window))
    chosen = F.array_distinct(F.flatten(F.transform(starts, lambda s: of(F.col("known"), s, span))))
    return known.select("passage", F.explode(chosen).alias("a")).select(F.col("a.term").alias("term"), "passage", F.col("a.place").alias("place"))


def _phrases(places: Column, span: Column) -> Column:
    """Of ascending places, those in runs of ``span`` or more."""
    starts = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + span - 1) == x + span - 1, F.lit(False)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + span - 1))))


def _most_in_window(places: Column, span: Column) -> Column:
    """Of ascending places, the most that one window of ``span`` places has."""
    return F.array_max(F.transform(places, lambda x, i: F.size(F.filter(F.slice(places, i + 1, span), lambda y: y < x + span))))


def matches(postings: DataFrame, passages: DataFrame, window: int, near: int, slack: int) -> DataFrame:
    """``row, passage, shift, hit, near``: what each meeting diagonal has; ``hit`` are places in exact phrases."""
    # Spark broadcasts these staged tables of the benchmark only while their files are below its broadcast limit.
    frequency = staged(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    anchors = staged(anchors_of(passages, frequency, window), "anchors")
    lists = postings.join(anchors, "term").select("row", "passage", (F.col("pos") - F.col("place")).alias("shift"), "place")
    length = passages.select("passage", F.size("terms").alias("length"))
    met = lists.groupBy("row", "passage", "shift").agg(F.count(F.lit(1)).alias("n")).join(length, "passage").where("n >= least(2, length)")
    met = staged(met.select("row", "passage", "shift"), "met")
    asked = met.join(passages, "passage").select("row", "passage", "shift", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("off")).withColumn("pos", F.col("shift") + F.col("place") + F.col("off")).where("pos >= 0")
    held = perhaps_in(postings, bitmap_of(met.select("row").distinct(), "row"), "row").where("perhaps").drop("perhaps")
    # Merged at every size, so that the plan and its shuffle grow in proportion.
    agreed = asked.join(held.hint("merge"), ["row", "pos", "term"]).groupBy("row", "passage", "shift", "length")
    agreed = agreed.agg(F.sort_array(F.collect_set(F.when(F.col("off") == 0, F.col("place")))).alias("exact"), F.sort_array(F.collect_set("place")).alias("about"))
    span = F.least(F.lit(window), F.col("length"))
    out = agreed.select("row", "passage", "shift", _phrases(F.col("exact"), span).alias("hit"), (_most_in_window(F.col("about"), span) >= F.least(F.lit(near), span)).alias("near"))
    out = staged(out.where("near or size(hit) > 0"), "matches")
    for done in (frequency, anchors, met):
        discard(done, postings.sparkSession)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int = 8, slack: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep`` and ``n_words, n_hit, n_items, items, n_near_items, contaminated``; ``items`` are ids as sorted strings."""
    spark = docs.sparkSession
    # Item ids may be null or stand for several texts, and texts may have several ids: each text is one passage with its own key.
    items = staged(item_words(benchmark), "items")
    passages = items.select("item_words").distinct().select(F.monotonically_increasing_id().alias("passage"), F.col("item_words").alias("terms"))
    passages = staged(passages, "passages")
    named = staged(items.join(passages, F.col("item_words") == F.col("terms")).select("passage", F.col("item_id").cast("string").alias("item")), "named")
    # Whole rows travel as one column, since they may have any names.
    words = docs.select(F.struct(*keep).alias("kept_row"), split_words(F.col("text")).alias("words"))
    rows = staged(words.select(F.monotonically_increasing_id().alias("row"), "kept_row", F.size("words").cast("long").alias("n_words"), "words"), "rows")
    vocabulary = staged(passages.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    spread = rows.select("row", F.posexplode("words").alias("pos", "word")).select("row", "pos", fold(F.col("word")).alias("term"))
    postings = staged(spread.join(vocabulary, "term", "left_semi"), "postings")
    found = matches(postings, passages, window, near, slack)
    discard(postings, spark)

    places = found.select("row", F.explode(F.transform("hit", lambda p: F.col("shift") + p)).alias("p")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    by_item = found.join(named, "passage").groupBy("row", "item").agg(F.max(F.size("hit") > 0).alias("whole")).groupBy("row")
    by_item = by_item.agg(F.array_sort(F.collect_list(F.when(F.col("whole"), F.struct("item")))).alias("whole"), F.count(F.lit(1)).alias("n_all"))
    judged = by_item.join(places, "row", "left").select("row", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.transform("whole", lambda x: x["item"]).alias("items"), (F.col("n_all") - F.size("whole")).alias("n_near_items"))
    judged = staged(judged, "judged")
    told = perhaps_in(rows.drop("words"), bitmap_of(judged, "row"), "row")
    none = F.array().cast("array<string>")
    clean = told.where("not perhaps").select("kept_row", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.lit(0).cast("long").alias("n_near_items"))
    hit = told.where("perhaps").join(judged.hint("merge"), "row", "left").select("kept_row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none), F.coalesce("n_near_items", F.lit(0)).cast("long"))
    return clean.union(hit).select(*(F.col("kept_row").getField(c).alias(c) for c in keep), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "n_near_items", (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, k FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
