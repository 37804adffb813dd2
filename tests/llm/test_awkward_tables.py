"""Every document operator on repeated rows, null ids, equal ids of different texts, clashing column names, and an empty table."""

import pytest

from quernstone.llm import queries

LONG = " ".join(f"w{i % 977} token{i}" for i in range(6000))
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "another text token=abcdef1 9.8.7.6"), (None, "a b c d e f"), (None, None), (2, ""), (2, None), (3, LONG), (3, LONG), (4, LONG + " tail")]
CLASHING = ("kept", "row", "words", "node", "unit", "items", "key", "blob_id", "findings", "bucket", "label", "piece", "part", "perhaps", "term", "own_text")
#: Columns that say where something stands, so that equal rows differ in them.
PLACES = {"start", "sequence_id", "offset"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("awkward")
    extra = [f"'x' AS {c}" for c in CLASHING]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars", *extra)
    for name, rows in (("full", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{path}/{name}/documents.parquet")
        spark.createDataFrame([(9, "another text"), (None, LONG[:200])], "item_id long, text string").write.parquet(f"{path}/{name}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op3_warc_reader"}))
def test_repeated_rows_null_ids_and_no_rows(spark, folder, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, f"{folder}/full").collect()]
    whole = [r for r in got if r.get("piece", 0) == 0]
    assert sorted(str(r["doc_id"]) for r in whole) == sorted(str(d) for d, _ in ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(tuple(str(v) for k, v in sorted(r.items()) if k not in PLACES))
    assert max(map(by_id[3].count, by_id[3])) == min(map(by_id[3].count, by_id[3])) == 2  # copies of the long text, piece by piece
    assert max(map(by_id[1].count, by_id[1])) == 2 and len(set(by_id[1])) == 2
    assert queries.QUERIES[name](spark, f"{folder}/none").count() == 0


def test_components_and_windows_of_repeated_rows(spark, folder):
    found = queries.QUERIES["op4_grouped_prefix_join"](spark, f"{folder}/full").collect()
    assert sorted((str(r.doc_id), r.n_shingles > 0, str(r.component_id)) for r in found) == sorted(
        [("1", True, "1")] * 2 + [("1", True, "1"), ("None", True, "1"), ("None", False, "None")] + [("2", False, "2")] * 2 + [("3", True, "3")] * 2 + [("4", True, "3")]
    )
    removed = {(r.doc_id, r.n_words, r.n_removed) for r in queries.QUERIES["op6_block_anchors"](spark, f"{folder}/full").collect()}
    assert removed >= {(3, 12_000, 12_000), (4, 12_001, 12_000), (1, 6, 0), (2, 0, 0), (None, 0, 0)}


def test_pipeline_on_awkward_tables(spark, folder):
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{folder}/full").collect()} <= {1, 2, 3, 4, None}
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
