"""Readers and writers on files written here, and small cases worked out by hand."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions.text import clean, clean_strict, shingles, tokens, without_stop_words
from quernstone.operators import evaluation, graph, profile, recommend, series, similarity, words
from quernstone.sources import readers
from quernstone.streaming import jobs


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_power(spark, put):
    path = put("p.txt", "Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3\n1/1/2007;00:00:00;1.5;?;240.1;2.0;0;0;1\n1/1/2007;00:01:00;?;0.1;?;?;0;0;\n")
    rows = readers.power(spark, path).collect()
    assert [(r.Global_active_power, r.Global_reactive_power, r.Voltage) for r in rows] == [(1.5, None, 240.1), (None, 0.1, None)]


def test_news_quotes_and_nulls(spark, put):
    path = put("n.csv", 'IDLink,Title,Headline,Source,Topic,PublishDate,SentimentTitle,SentimentHeadline,Facebook,GooglePlus,LinkedIn\n1,"He said ""yes"", then",,S,economy,2015-11-08 10:00:00,0.1,-0.2,-1,-1,-1\n')
    (row,) = readers.news(spark, path).collect()
    assert row.Title == 'He said "yes", then' and row.Headline is None and row.PublishDate.hour == 10 and row.Facebook == -1


def test_feedback_of_all_topics(spark, put, tmp_path):
    head = "IDLink," + ",".join(f"TS{i}" for i in range(1, 145))
    for k, topic in enumerate(("Economy", "Microsoft", "Obama", "Palestine")):
        put(f"Facebook_{topic}.csv", f"{head}\n{k}," + ",".join(str(i % 3) for i in range(144)) + "\n")
    got = readers.feedback(spark, str(tmp_path), "Facebook")
    assert got.count() == 4
    slots = series.slot_averages(got, 72).where("IDLink = 0").first()
    assert (slots.slot0, slots.slot1) == (1.0, 1.0)


def test_ratings_and_movies(spark, put):
    assert [tuple(r) for r in readers.ratings(spark, put("r.dat", "1::1193::5::978300760\n2::661::3::978302109\n")).collect()] == [(1, 1193, 5, 978300760), (2, 661, 3, 978302109)]
    (movie,) = readers.movies(spark, put("m.dat", "1::Toy Story (1995)::Animation|Children's\n")).collect()
    assert (movie.Title, movie.Genres) == ("Toy Story (1995)", "Animation|Children's")


def test_space_separated_with_and_without_header(spark, put):
    assert [tuple(r) for r in readers.delimited(spark, put("s.txt", "1.0 2.0\n3.0 4.0\n"), "a double, b double", sep=" ", header=False).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    assert readers.delimited(spark, put("h.txt", "_1 _2\nx 1\n"), "_1 string, _2 int", sep=" ").collect()[0]._2 == 1


def test_tagged_bodies(spark, put):
    path = put("d.sgm", "<X><BODY>first\nlines</BODY></X><BODY></BODY>no<BODY>third</BODY>")
    assert [(r.position, r.content) for r in readers.tagged_bodies(spark, path).orderBy("position").collect()] == [(0, "first\nlines"), (1, ""), (2, "third")]


def test_messages_also_encoded_twice(spark):
    df = spark.createDataFrame([(7, 1.5), (8, None)], "id long, amount double")
    sent = readers.to_messages(df, "id")
    assert [r.key for r in sent.collect()] == ["7", "8"]
    assert readers.json_events(sent, "id long, amount double").collect() == df.collect()
    twice = sent.select(F.expr("concat('\"', replace(value, '\"', '\\\\\"'), '\"')").alias("value"))
    assert readers.json_events(twice, "id long, amount double").collect() == df.collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n {i}") for i in range(20)], "id long, name string").repartition(4)
    readers.write_single_csv(df, str(tmp_path / "c"), sep=" ")
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    assert readers.delimited(spark, str(tmp_path / "c"), "id long, name string", sep=" ").count() == 20
    readers.write_parquet(df.withColumn("k", F.col("id") % 2), str(tmp_path / "p"), ("k",))
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() == 10




def test_graph_drop_out_and_repeated_edges(spark, put):
    path = put("g.txt", "# Nodes: 3 Edges: 3\n# FromNodeId\tToNodeId\n0\t1\n1\t0\n2\t0\n")
    edges = readers.edges(spark, path)
    assert {r.src: r.out_degree for r in graph.out_degree(edges).collect()} == {0: 1, 1: 1, 2: 1}
    assert {r.dst: r.in_degree for r in graph.in_degree(edges).collect()} == {0: 2, 1: 1}
    rank = lambda n, **k: {r.node: round(r.rank, 6) for r in graph.pagerank(edges, rounds=n, **k).collect()}
    assert rank(1) == {0: 1.85, 1: 1.0}
    assert rank(2) == {0: 1.0, 1: 1.7225}
    assert rank(1, keep_all=True) == {0: 1.85, 1: 1.0, 2: 0.15}
    twice = spark.createDataFrame([(0, 1), (0, 1)], "src long, dst long")
    assert graph.out_degree(twice).first().out_degree == 2 and graph.pagerank(twice, rounds=1).first().rank == 1.0
    assert graph.pagerank(edges.limit(0), rounds=2).count() == 0


def test_ranks_over_lists_of_targets(spark, monkeypatch):
    """A round joins one row for a list of targets; nulls, repeated edges and targets in many lists count as they did edge by edge."""
    monkeypatch.setattr(graph, "LIST", 4)
    rows = [(s, d) for s in range(6) for d in range(9) if (s * d) % 4 != 3] * 2 + [(0, None), (None, 1), (7, None), (7, 0)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    links = {}
    made = graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df, label: links.update({label: made(df, label)}) or links[label])
    for keep in (False, True):
        rank = {s: 1.0 for s, _ in rows if s is not None}
        clean = {(s, d) for s, d in rows if s is not None}
        for _ in range(3):
            got = collections.defaultdict(float)
            for s, d in clean:
                if s in rank:
                    got[d] += rank[s] / sum(a == s for a, _ in clean)
            rank = {d: 0.85 * g + 0.15 for d, g in got.items()}
            if keep:
                rank = {v: rank.get(v, 0.15) for e in clean for v in e if v is not None} | ({None: 0.15} if None in got else {})
        found = {r.node: r.rank for r in graph.pagerank(edges, rounds=3, keep_all=keep, cut_every=2).collect()}
        assert found == {v: pytest.approx(r) for v, r in rank.items()}
    lists = [r.targets for r in links["pagerank-links"].collect()]
    assert 8 < len(lists) < len(clean) and sum(map(len, lists)) == len(clean)


def test_neighbours(spark):
    edges = spark.createDataFrame([(1, 3), (1, 2), (2, 1), (1, 2)], "src long, dst long")
    assert {r.side: r.nodes for r in graph.neighbours(edges, 1).collect()} == {"successors": "[2, 3]", "predecessors": "[2]"}


def test_similarity_of_constant_ratings_is_undefined(spark):
    rated = spark.createDataFrame([(1, 10, 5.0), (2, 10, 5.0), (1, 20, 1.0), (2, 20, 3.0), (1, 30, 2.0), (2, 30, 4.0)], "user long, item long, rating double")
    assert recommend.similar_items(rated, 10, 1).count() == 0
    assert {r.item: r.similarity for r in recommend.similar_items(rated, 20, 1).collect()} == {20: 1.0, 30: 1.0}
    assert {r.item: r.avg_rating for r in recommend.top_rated(rated).collect()} == {10: 5.0, 20: 2.0, 30: 3.0}


def test_near_duplicates_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b c a b"), (1, "b c a"), (2, "x y"), (3, "one"), (4, None)], "doc_id long, text string")
    pairs = similarity.shingle_pairs(docs)
    assert {d: sorted(r.shingle for r in pairs.where(f"doc_id = {d}").collect()) for d in range(5)} == {0: ["a b", "b c", "c a"], 1: ["b c", "c a"], 2: ["x y"], 3: [], 4: []}
    assert {r.shingle: r.shingle_id for r in similarity.shingle_ids(pairs).collect()} == {"a b": 1, "b c": 2, "c a": 3, "x y": 4}
    least = lambda ids: [min((x * a + b) % similarity.PRIME for x in ids) for a, b in similarity.coefficients(5)]
    rows = similarity.signatures(similarity.shingle_matrix(pairs), n=5).orderBy("doc_id", "hash_no").collect()
    assert [r.min_hash for r in rows] == least([1, 2, 3]) + least([2, 3]) + least([4])


def test_matrix_of_many_partitions_repeated_rows_and_null_ids(spark):
    texts = ["a b c a b", "b\tc a", "", "one", None, "a b", "c a  b.c", "a! b a b"] + [f"w{i % 7} x{i % 5} a b" for i in range(40)]
    rows = [(d if d else None, t) for d, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = {(d, f"{v} {w}") for d, t in rows for u in [re.sub(" +", " ", re.sub("[?,.$]", " ", t or "")).strip().split(" ")] for v, w in zip(u, u[1:], strict=False)}
    ids = {s: i + 1 for i, s in enumerate(sorted({s for _, s in pairs}))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        matrix = similarity.document_matrix(docs)
        got = [tuple(r) for r in matrix.select("shingle_id", "doc_id").collect()]
        signs = {r.doc_id: r.s for r in similarity.whole_signatures(matrix, n=4, prime=11).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted(got, key=repr) == sorted(((ids[s], d) for d, s in pairs), key=repr)
    assert signs == {d: [min((ids[s] * a + b) % 11 for e, s in pairs if e == d) for a, b in similarity.coefficients(4, 11)] for d in {d for d, _ in pairs}}
    assert similarity.signatures(similarity.document_matrix(docs.limit(0))).count() == 0


def test_signatures_shuffle_one_row_for_each_pair(spark):
    """Partial minima of every map task for every document once made the shuffle grow with documents times tasks."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    matrix = spark.range(1000).selectExpr("id AS shingle_id", "id % 10 AS doc_id")
    text = plan(similarity.signatures(matrix))
    assert text.count("Exchange") == 1 and "Aggregate" not in text
    pairs = spark.createDataFrame([(0, "a b"), (1, "a b")], "doc_id long, shingle string")
    assert "SortMergeJoin" not in plan(similarity.shingle_matrix(pairs))


def test_no_pair_is_formed_where_none_can_reach_the_threshold(spark):
    """One bucket held by all: 4,498,500 pairs, each with one of two buckets in common, against 0.01 x 3000 documents."""
    signature = spark.range(3000).selectExpr("id AS doc_id", "array(7L, id) AS s")
    pairs = similarity.lsh_pairs(signature)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "bands" in plan and "least" in plan.split("SortMergeJoin")[-1]
    few = similarity.lsh_pairs(signature.where("doc_id < 100")).collect()
    assert len(few) == 4950 and {r.common for r in few} == {1}


def test_both_forms_of_signatures_give_the_same_classes_and_pairs(spark):
    whole = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 2, 3]), (2, [1, 2, 4]), (None, [5, 6, 7]), (4, [12, 3, 9])], "doc_id long, s array<long>")
    long = whole.select("doc_id", F.posexplode("s").alias("hash_no", "min_hash"))
    for form in (whole, long):
        assert {r.doc_id: r.class_id for r in similarity.lsh_classes(form).collect()} == {0: 0, 1: 0, 2: 2, None: None, 4: 4}
        assert [tuple(r) for r in similarity.lsh_pairs(form, 2, 0.5, of_bands=True).collect()] == [(0, 2, 1)]


def test_shingles_are_linear_in_the_text(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (1000, 16_000)], "doc_id long, text string")
    assert {r.doc_id: r.n for r in docs.select("doc_id", F.size(shingles(F.split("text", " "), 3)).alias("n")).collect()} == {1000: 998, 16_000: 15_998}


def test_text_and_words(spark):
    df = spark.createDataFrame([("a  the b ",), ("",), (None,)], "text string")
    assert [r.w for r in df.select(without_stop_words(tokens(clean(F.col("text")))).alias("w")).collect()] == [["", "b"], [""], [""]]
    sentences = spark.createDataFrame([(1, "k", "x1 y1 y1"), (2, "k", "x1 z1")], "doc_id long, topic string, text string")
    assert {(r.w1, r.w2): r.cnt for r in words.cooccurrence(sentences, "topic").collect()} == {("x1", "y1"): 1, ("y1", "x1"): 1, ("x1", "z1"): 1, ("z1", "x1"): 1}


def test_texts_of_a_key_do_not_meet_in_one_task(spark):
    rows = [(i, "k" if i % 9 else "m", f"x{i % 3} y{i % 2} z") for i in range(60)]
    found = words.cooccurrence(spark.createDataFrame(rows, "doc_id long, topic string, text string"), "topic")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = collections.Counter((k, a, b) for _, k, t in rows for a in t.split() for b in t.split() if a != b)
    assert {(r.topic, r.w1, r.w2): r.cnt for r in found.collect()} == want


def test_classes_of_characters(spark):
    chars = spark.createDataFrame([(chr(c),) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [("\U0001F600",), ("a\u0301",)], "c string")
    old = lambda pattern, by: F.regexp_replace("c", pattern, by)
    assert chars.where(F.trim(F.lower(old(r"[^\sa-zA-Z0-9]", ""))) != clean(F.col("c"))).count() == 0
    strict = F.trim(F.regexp_replace(F.regexp_replace(F.lower("c"), r"[^a-z\s]", " "), r"\s+", " "))
    assert chars.where(strict != clean_strict(F.col("c"))).count() == 0


def test_rare_terms_of_a_bag_do_not_move(spark, monkeypatch):
    rows = [(1, "common once"), (1, "common twice"), (None, "common shared"), (None, "shared"), (3, "shared rare0"), *((i, f"common rare{i % 5}x rare{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(4, 99))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, made = {}, words.materialised
    monkeypatch.setattr(words, "materialised", lambda df, label: seen.update({label: made(df, label)}) or seen[label])
    got = {(r.doc_id, r.term): r.cnt for r in words.bag_of_words(docs, min_share=0.03).collect()}
    assert {r.term for r in seen["bags"].select("term").distinct().collect()} <= {"common", "rare", "shared", "rarex"}
    counts = collections.Counter((d, w) for d, t in rows for w in re.sub("[^a-z]", " ", t).split() if len(w) >= 4)
    held = collections.Counter(w for _, w in counts)
    assert got == {k: n for k, n in counts.items() if held[k[1]] >= 0.03 * len(rows)}


def test_profiles(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert sorted(r.v for r in profile.impute_mean(df, ["v"]).collect()) == [1.0, 2.5, 4.0]
    train, test = profile.hash_split(spark.range(2000).withColumnRenamed("id", "k"), "k")
    assert train.count() + test.count() == 2000 and train.join(test, "k").count() == 0 and 1500 < train.count() < 1700
    steps = (lambda d: profile.impute_mean(d, ["v"]), lambda d: profile.minmax_normalize(d, ["v"]))
    assert sorted(r.norm_v for r in profile.compose(df, *steps).collect()) == [0.0, 0.5, 1.0]


def test_quartiles_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), ("b", None)], "k string, v double")
    assert {r.k: (r.n, r.q1, r.q2, r.q3) for r in series.quartiles(df, ["k"], "v").collect()} == {"a": (3, 1.0, 1.0, 2.5), None: (1, 2.0, 2.0, 2.0)}
    assert series.quartiles(df.limit(0), ["k"], "v").count() == 0


def test_evaluation_by_hand(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert sorted((r.threshold, r.fpr, r.tpr) for r in evaluation.roc(df, "label", "score").collect()) == [(0.1, 1.0, 1.0), (0.8, 0.5, 1.0), (0.9, 0.0, 0.5)]
    assert evaluation.auc(df, "label", "score").first().auc == 0.875
    assert evaluation.auc(df.limit(0), "label", "score").first().auc is None


def test_streams(spark, sf_dir, tmp_path):
    stream = jobs.file_stream(spark, sf_dir, "events").select("event_id", "value")
    jobs.run(stream, str(tmp_path / "state"), sink=jobs.table_sink(str(tmp_path / "out"))).awaitTermination()
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    jobs.run(stream, str(tmp_path / "state"), sink=jobs.table_sink(str(tmp_path / "out"))).awaitTermination()  # the state knows what is done
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    assert [tuple(r) for r in jobs.batch_counts(stream, "counts").collect()] == [(0, n)]


def test_word_counts_both_ways(spark):
    df = spark.createDataFrame([("a  the b B,",), ("",), (None,), ("b the",)], "text string")
    assert sorted(map(tuple, words.text_word_counts(df).collect())) == sorted(map(tuple, words.word_counts(words.tokenized(df)).collect())) == [("", 3), ("b", 3)]
