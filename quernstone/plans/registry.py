"""All registered queries of the engine over the driver's tables, and the SQL that states the same.

Doubles are rounded to six digits on both sides where the order of additions may differ. The ratings are a projection: a customer
rates a part by the mean quantity ordered. So is the graph: supplier -> part number modulo the number of suppliers, one edge for each
line. Slot averages cover the first two days, which is what 144 slices of 20 minutes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import STOP_WORDS
from quernstone.operators import evaluation, graph, profile, recommend, series, similarity, words
from quernstone.sources.readers import json_events, table, to_messages
from quernstone.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
START = "2024-01-01 00:00:00"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- profiles and features

_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std FROM lineitem" for c in NUMERIC)


@query(_PROFILE)
def column_profile(spark, sf_dir):
    return rounded(profile.column_profile(table(spark, sf_dir, "lineitem"), NUMERIC), "mean", "std")


@query("SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), avg(nullif(l_discount, 0)) OVER ()), 6) AS l_discount FROM lineitem")
def impute_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return rounded(profile.impute_mean(lines, ["l_discount"]), "l_discount")


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS norm_{c}" for c in NUMERIC) + " FROM lineitem")
def minmax_normalize(spark, sf_dir):
    out = profile.minmax_normalize(table(spark, sf_dir, "lineitem").select(*KEYS, *NUMERIC), NUMERIC)
    return rounded(out.drop(*NUMERIC), *(f"norm_{c}" for c in NUMERIC))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z_o_totalprice FROM orders")
def standardize(spark, sf_dir):
    return rounded(profile.standardize(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice"), "z_o_totalprice")


@query("SELECT c AS column_name, nulls, 0 AS nans, round(nulls / n, 4) * 100 AS null_percent, d AS distinct_values FROM (SELECT 'l_discount' AS c, count(*) FILTER (l_discount = 0) AS nulls, count(*) AS n, count(DISTINCT nullif(l_discount, 0)) AS d FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0), count(*), count(DISTINCT nullif(l_tax, 0)) FROM lineitem)")
def null_nan_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*(F.nullif(c, F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")))
    return profile.null_nan_profile(lines, ["l_discount", "l_tax"])


_TOP_BRANDS = "SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 9"


@query(f"SELECT p_partkey, CASE WHEN p_brand IN ({_TOP_BRANDS}) THEN p_brand ELSE 'other' END AS brand FROM part")
def category_fold(spark, sf_dir):
    return profile.fold_categories(table(spark, sf_dir, "part"), "p_brand", 10, "brand").select("p_partkey", "brand")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, " + ", ".join(f"""CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS "o_orderpriority_{p}\"""" for p in _PRIORITIES) + " FROM orders")
def one_hot(spark, sf_dir):
    return profile.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _PRIORITIES).drop("o_orderpriority")


@query("SELECT event_id, round(CASE WHEN skewness(value) OVER () > 1 THEN log10(value + 1 - least(0, min(value) OVER ())) ELSE value END, 6) AS log_value FROM events")
def log_skew(spark, sf_dir):
    return rounded(profile.log_skewed(table(spark, sf_dir, "events").select("event_id", "value"), "value", "log_value").drop("value"), "log_value")


@query("SELECT count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, round(avg(toxic) * 100, 6) AS positive_percent FROM labels")
def label_share(spark, sf_dir):
    return rounded(profile.labels_share(table(spark, sf_dir, "labels"), "toxic"), "positive_percent")


# ---- text

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_CLEAN = r"trim(lower(regexp_replace({}, '[^\sa-zA-Z0-9]', '', 'g')))"
_TOKENS = rf"SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(regexp_split_to_array({_CLEAN.format('text')}, '\s')) AS word FROM documents) WHERE word NOT IN ({_STOP})"
_TOP = "SELECT lang, word, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS rank FROM (SELECT lang, word, count(*) AS cnt FROM t GROUP BY ALL)) WHERE rank <= 100"


@query(f"SELECT word, count(*) AS cnt FROM ({_TOKENS}) GROUP BY word")
def wordcount_total(spark, sf_dir):
    return words.text_word_counts(table(spark, sf_dir, "documents"))


@query(f"WITH t AS ({_TOKENS}) {_TOP}")
def wordcount_per_topic(spark, sf_dir):
    return words.top_words(words.text_word_counts(table(spark, sf_dir, "documents"), ["lang"]), ["lang"])


@query(rf"""SELECT day, word, count(*) AS cnt FROM (SELECT CAST(ts AS DATE) AS day, unnest(regexp_split_to_array({_CLEAN.format("event_type || ' ' || props")}, '\s')) AS word FROM events) WHERE word NOT IN ({_STOP}) GROUP BY ALL""")
def wordcount_per_day(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return words.text_word_counts(events, ["day"])


@query(rf"""WITH t AS ({_TOKENS}), v AS ({_TOP}),
s AS (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array({_CLEAN.format('text')}, ' ')) AS word FROM documents),
h AS (SELECT doc_id, lang, word FROM s SEMI JOIN v USING (lang, word))
SELECT x.lang, x.word AS w1, y.word AS w2, count(*) AS cnt FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.word <> y.word GROUP BY ALL""")
def cooccurrence_topk(spark, sf_dir):
    return words.cooccurrence(table(spark, sf_dir, "documents"), "lang")


_STRICT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '@\w+', ' ', 'g'), 'http\S+', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_split_to_array({_STRICT}, ' ')) AS term FROM documents) WHERE length(term) >= 4 AND term NOT IN ({_STOP}) GROUP BY ALL)
SELECT * FROM b WHERE term IN (SELECT term FROM b GROUP BY term HAVING count(*) >= 0.01 * (SELECT count(*) FROM documents))""")
def bag_of_words(spark, sf_dir):
    return words.bag_of_words(table(spark, sf_dir, "documents"))


# ---- time series

_SLICE = f"SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 1200000000) AS INTEGER) AS s, value FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{START}' + INTERVAL 2 DAY"


def _slots(size: int) -> str:
    return "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (s // {size} = {k}), 0) / {size}, 6) AS slot{k}" for k in range(144 // size)) + f" FROM ({_SLICE}) GROUP BY user_id"


def _slot_query(spark, sf_dir, size):
    out = series.slot_averages(series.wide_slices(table(spark, sf_dir, "events"), "user_id", START), size)
    return rounded(out, *(f"slot{k}" for k in range(144 // size)))


@query(_slots(3))
def slot_average_hour(spark, sf_dir):
    return _slot_query(spark, sf_dir, 3)


@query(_slots(72))
def slot_average_day(spark, sf_dir):
    return _slot_query(spark, sf_dir, 72)


@query("SELECT hour(ts) AS hour, count(*) AS n, " + ", ".join(f"round(quantile_cont(ln(value), {q}), 6) AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM events WHERE value > 0 GROUP BY ALL")
def by_hour(spark, sf_dir):
    return rounded(series.by_hour(table(spark, sf_dir, "events")), "q1", "q2", "q3")


@query("SELECT dayname(ts) AS weekday, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM events WHERE value > 0 GROUP BY ALL")
def by_weekday(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value > 0").select(F.date_format("ts", "EEEE").alias("weekday"), "value")
    return rounded(series.quartiles(events, ["weekday"], "value"), "q1", "q2", "q3")


@query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS happened FROM events ORDER BY ts, event_id LIMIT 50")
def earliest_events(spark, sf_dir):
    return series.earliest(table(spark, sf_dir, "events"), 50, "event_id").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("happened"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def count_per_day(spark, sf_dir):
    return series.per_day(table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT hour(ts) AS hour, dayname(ts) AS weekday, round(avg(value), 6) AS mean_value, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL")
def popularity_by_hour(spark, sf_dir):
    return rounded(series.popularity(table(spark, sf_dir, "events")), "mean_value")


# ---- relational

@query("SELECT l_returnflag, round(sum(l_extendedprice + l_tax), 2) AS sum_value, round(avg(l_extendedprice + l_tax), 6) AS avg_value FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL")
def group_sum_avg(spark, sf_dir):
    value = F.col("l_extendedprice") + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").where("l_returnflag is not null").groupBy("l_returnflag").agg(F.round(F.sum(value), 2).alias("sum_value"), F.round(F.avg(value), 6).alias("avg_value"))


@query("SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_enrich(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT o_orderpriority AS label, o_orderstatus AS kind FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity = 50")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("kind")))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10")
def topk_per_group(spark, sf_dir):
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id")
def user_activity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("types"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, user_id, value FROM events")
def json_round_trip(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return json_events(to_messages(events, "event_id").select("value"), "event_id long, user_id long, value double")


# ---- similarity

_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\n', ' ', 'g'), '<body>', '', 'g'), '[?,.$]', ' ', 'g'), '\r', ' ', 'g'), ' +', ' ', 'g'), ' reuter &#3;</body>', '', 'g'))"
_PAIRS = f"SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM (SELECT doc_id, string_split({_BODY}, ' ') AS w FROM documents))"
_MATRIX = f"SELECT dense_rank() OVER (ORDER BY shingle) AS shingle_id, doc_id FROM ({_PAIRS})"
_HASHES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(similarity.coefficients()))
_SIGNATURE = f"SELECT doc_id, hash_no, min(({{x}} * a + b) % {similarity.PRIME}) AS min_hash FROM ({_MATRIX}), (VALUES {_HASHES}) h(hash_no, a, b) GROUP BY doc_id, hash_no".format(x="shingle_id")


@query(_PAIRS)
def shingle_pairs(spark, sf_dir):
    return similarity.shingle_pairs(table(spark, sf_dir, "documents"))


@query(_MATRIX)
def shingle_matrix(spark, sf_dir):
    return similarity.document_matrix(table(spark, sf_dir, "documents"))


@query(_SIGNATURE)
def minhash_signature(spark, sf_dir):
    return similarity.signatures(shingle_matrix(spark, sf_dir))


@query(f"""WITH s AS ({_SIGNATURE}), k AS (SELECT doc_id, list(min_hash ORDER BY hash_no) AS v FROM s GROUP BY doc_id),
c AS (SELECT min(doc_id) AS doc_id FROM k GROUP BY v), r AS (SELECT s.* FROM s SEMI JOIN c USING (doc_id))
SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS common FROM r x JOIN r y ON x.hash_no = y.hash_no AND x.min_hash = y.min_hash AND x.doc_id < y.doc_id
GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM k)""")
def lsh_pairs_of_documents(spark, sf_dir):
    """The rule as it was first stated: one-row bands, and a threshold that grows with the number of documents."""
    return similarity.lsh_pairs(similarity.whole_signatures(shingle_matrix(spark, sf_dir)))


@query(f"""WITH s AS ({_SIGNATURE}), k AS (SELECT doc_id, list(min_hash ORDER BY hash_no) AS v FROM s GROUP BY doc_id),
c AS (SELECT min(doc_id) AS doc_id FROM k GROUP BY v),
r AS (SELECT doc_id, hash_no // 4 AS band, list(min_hash ORDER BY hash_no) AS bucket FROM s SEMI JOIN c USING (doc_id) GROUP BY ALL)
SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS common FROM r x JOIN r y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id
GROUP BY ALL HAVING count(*) >= 5""")
def lsh_pairs(spark, sf_dir):
    return similarity.lsh_pairs(similarity.whole_signatures(shingle_matrix(spark, sf_dir)), rows_per_band=4, threshold=0.2, of_bands=True)


@query(f"WITH s AS ({_SIGNATURE}), k AS (SELECT doc_id, list(min_hash ORDER BY hash_no) AS v FROM s GROUP BY doc_id) SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS class_id FROM k")
def lsh_classes(spark, sf_dir):
    return similarity.lsh_classes(similarity.whole_signatures(shingle_matrix(spark, sf_dir)))


@query("SELECT v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) t")
def cosine_dense(spark, sf_dir):
    return rounded(similarity.cosine_to(table(spark, sf_dir, "embeddings"), 0), "cosine")


# ---- recommendation

USER, ITEM = 1, 0
_RATINGS = 'ratings AS (SELECT o_custkey AS "user", l_partkey AS item, round(avg(l_quantity), 6) AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)'


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.round(F.avg("l_quantity"), 6).alias("rating"))


def _cosine_sql(by: str, across: str, target: int) -> str:
    return f'''{_RATINGS},
c AS (SELECT "user", item, rating, rating - avg(rating) OVER (PARTITION BY "{by}") AS x FROM ratings),
n AS (SELECT "{by}", sqrt(sum(x * x)) AS norm FROM c GROUP BY "{by}"),
o AS (SELECT "{across}", x AS y FROM c WHERE "{by}" = {target}),
sims AS (SELECT c."{by}", round(sum(coalesce(x * y, 0)) / any_value(norm * (SELECT sqrt(sum(y * y)) FROM o)), 6) AS similarity FROM c JOIN n ON n."{by}" = c."{by}" LEFT JOIN o ON o."{across}" = c."{across}" WHERE norm > 1e-9 AND (SELECT sqrt(sum(y * y)) FROM o) > 1e-9 GROUP BY c."{by}")'''


_SIM_USERS = f'{_cosine_sql("user", "item", USER)}, near AS (SELECT * FROM sims WHERE "user" <> {USER} ORDER BY similarity DESC, "user" LIMIT 100)'


@query("SELECT item, round(avg(rating), 6) AS avg_rating FROM ratings GROUP BY item".replace("SELECT", f"WITH {_RATINGS} SELECT", 1))
def top_rated(spark, sf_dir):
    return rounded(recommend.top_rated(ratings(spark, sf_dir)), "avg_rating")


@query(f"WITH {_SIM_USERS} SELECT * FROM near")
def similar_users(spark, sf_dir):
    return recommend.similar_users(ratings(spark, sf_dir), USER)


@query(f'WITH {_cosine_sql("item", "user", ITEM)} SELECT * FROM sims WHERE item IN (SELECT item FROM ratings WHERE "user" = {USER}) ORDER BY similarity DESC, item LIMIT 20')
def similar_items(spark, sf_dir):
    return recommend.similar_items(ratings(spark, sf_dir), ITEM, USER)


@query(f'WITH {_SIM_USERS} SELECT p_name AS title, round(prediction, 6) AS prediction FROM (SELECT item, sum(similarity * rating) / (SELECT sum(similarity) FROM near) AS prediction FROM ratings JOIN near USING ("user") GROUP BY item) JOIN part ON item = p_partkey')
def user_cf(spark, sf_dir):
    rated = ratings(spark, sf_dir)
    found = recommend.user_predictions(rated, recommend.similar_users(rated, USER))
    return found.join(table(spark, sf_dir, "part"), F.col("item") == F.col("p_partkey")).select(F.col("p_name").alias("title"), F.round("prediction", 6).alias("prediction"))


@query(f'''WITH {_RATINGS},
m AS (SELECT item, rating AS own FROM ratings WHERE "user" = {USER}),
t AS (SELECT DISTINCT item AS target FROM ratings WHERE item NOT IN (SELECT item FROM m) ORDER BY 1 LIMIT 10),
c AS (SELECT "user", item, rating - avg(rating) OVER (PARTITION BY item) AS x FROM ratings),
n AS (SELECT item, sqrt(sum(x * x)) AS norm FROM c GROUP BY item HAVING sqrt(sum(x * x)) > 1e-9),
d AS (SELECT target, b.item, sum(a.x * b.x) AS dot FROM t JOIN c a ON a.item = target JOIN c b ON a."user" = b."user" WHERE b.item IN (SELECT item FROM m) GROUP BY ALL),
s AS (SELECT t.target, m.item, own, round(coalesce(dot, 0) / (n.norm * o.norm), 6) AS similarity FROM t CROSS JOIN m LEFT JOIN d ON d.target = t.target AND d.item = m.item JOIN n ON n.item = m.item JOIN n o ON o.item = t.target),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, item) AS k FROM s)
SELECT target AS item, round(sum(similarity * own) / CASE WHEN abs(sum(similarity)) > 1e-9 THEN sum(similarity) END, 6) AS prediction FROM r WHERE k <= 20 GROUP BY target''')
def item_cf(spark, sf_dir):
    return rounded(recommend.item_predictions(ratings(spark, sf_dir), USER), "prediction")


# ---- graph

_EDGES = "edges AS (SELECT l_suppkey AS src, l_partkey % (SELECT max(l_suppkey) + 1 FROM lineitem) AS dst FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = lines.agg((F.max("l_suppkey") + 1).alias("n"))
    return lines.crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), F.pmod("l_partkey", "n").alias("dst"))


@query(f"WITH {_EDGES} SELECT src, count(*) AS out_degree FROM edges GROUP BY src")
def out_degree(spark, sf_dir):
    return graph.out_degree(edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT dst, count(*) AS in_degree FROM edges GROUP BY dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(edges(spark, sf_dir))


@query(f"WITH {_EDGES} " + " UNION ALL ".join(f"SELECT '{side}' AS side, '[' || coalesce(array_to_string(list_sort(list(DISTINCT {b})), ', '), '') || ']' AS nodes FROM edges WHERE {a} = 1" for side, a, b in (("successors", "src", "dst"), ("predecessors", "dst", "src"))))
def neighbours(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), 1)


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), d AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e),
r AS (SELECT DISTINCT src AS node, CAST(1 AS DOUBLE) AS rank, 0 AS i FROM e UNION ALL SELECT d.dst, 0.15 + 0.85 * sum(r.rank / d.n), r.i + 1 FROM r JOIN d ON d.src = r.node WHERE r.i < 52 GROUP BY d.dst, r.i)
SELECT node, round(rank, 6) AS rank FROM r WHERE i = 52""")
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(edges(spark, sf_dir)), "rank")


# ---- evaluation

_SCORED = "s AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (label = 0 AND NOT score > 1000) AS tn, count(*) FILTER (label = 0 AND score > 1000) AS fp, count(*) FILTER (label = 1 AND NOT score > 1000) AS fn, count(*) FILTER (label = 1 AND score > 1000) AS tp FROM s)
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def eval_report(spark, sf_dir):
    return rounded(evaluation.confusion(_scored(spark, sf_dir), "label", "score", 1000.0), "accuracy", "precision", "recall", "f1")


@query(f"WITH {_SCORED} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT score FROM s WHERE label = 1) p, (SELECT score FROM s WHERE label = 0) n")
def auc(spark, sf_dir):
    return rounded(evaluation.auc(_scored(spark, sf_dir), "label", "score"), "auc")


@query(f"""WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score)
SELECT score AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr FROM g WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark, sf_dir):
    return rounded(evaluation.roc(_scored(spark, sf_dir), "label", "score"), "fpr", "tpr")


# ---- streams

def scorer(df: DataFrame):
    """A stand-in model: a saturating score of the event's value."""
    return F.col("value") / (F.col("value") + 100)


@query("SELECT event_id, user_id, round(value / (value + 100), 6) AS score FROM events WHERE value / (value + 100) > 0.5")
def fraud_filter_stream(spark, sf_dir):
    kept = jobs.scored_filter(jobs.file_stream(spark, sf_dir, "events"), scorer, 0.5)
    return rounded(jobs.run_to_table(kept.select("event_id", "user_id", "score"), "fraud"), "score")


@query("SELECT count(*) AS cnt FROM events")
def stream_count(spark, sf_dir):
    return jobs.run_complete(jobs.running_count(jobs.file_stream(spark, sf_dir, "events")), "count")


@query("SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS cnt FROM events")
def batch_counts(spark, sf_dir):
    return jobs.batch_counts(jobs.file_stream(spark, sf_dir, "events"), "batches")
