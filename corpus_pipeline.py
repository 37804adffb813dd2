"""A corpus pipeline of five stages, each written as Parquet and reread by the next.

Quality rules drop what they reject; of each group of near-duplicates the document with the smallest id stays; documents that
hold a benchmark passage are dropped; secrets are masked in place; what is left is packed into sequences.

Defined results: null and empty texts have no words, so the quality rules drop them; given to a later stage by themselves, they are
linked with nothing, hold no passage and no secret, and are packed as their end id alone. Repeated rows are one group of
near-duplicates, of which one row stays, also where ids are null or stand for several texts. An empty ``documents`` gives no
pieces, an empty ``benchmark`` drops nothing. Other columns of ``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, jaccard, packing, quality, secret_ledger
from quernstone.llm.queries import vocabulary
from quernstone.llm.rowmap import bitmap_of, perhaps_in, without
from quernstone.llm.staging import discard, in_full, staged, table


def _packed(docs: DataFrame) -> Column:
    """Whole rows as one column, since a table's other columns may have any names."""
    return F.struct(*docs.columns).alias("document")


def _content(*parts: str) -> Column:
    """A key of what a decision depends on; null and empty values differ."""
    return F.concat_ws(":", *(F.coalesce(F.sha2(F.col(p).cast("string").cast("binary"), 256), F.lit("-")) for p in parts)).alias("key")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def rejected() -> DataFrame:
        rows = docs.select("text", "lang", _content("text", "lang"))
        return quality.judge(rows, keep=("key",)).where("not kept").select("key").distinct()

    rows = docs.select(_content("text", "lang"), _packed(docs))
    return without(rows, in_full(spark, "rejected", rejected), "key").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest id, then text; null ids come last. Of rows that are equal in
    both, any one stays. Rows without words are linked with nothing, so each of them stays.
    """
    key = _content("doc_id", "text")

    def decided() -> DataFrame:
        """``key, again``: rows that go (false), and kept rows of which there are several (true)."""
        found = jaccard.similar_components(docs.select(key, "text").withColumnRenamed("key", "doc_id"), percent=80, width=5)
        member = staged(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).agg(F.count(F.lit(1)).alias("copies")), "members")
        lone = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).where("n > 1 or rows > 1").select("component")
        member = staged(member.join(lone.hint("merge"), "component"), "grouped")
        # Ids are looked up, and texts only where the smallest id of a component has several.
        rows = perhaps_in(docs.select(key, F.struct(F.col("doc_id").isNull(), "doc_id").alias("id"), "text"), bitmap_of(member, "key"), "key").where("perhaps")
        member = staged(member.join(rows.select("key", "id").distinct().hint("merge"), "key"), "with-ids")
        low = member.groupBy("component").agg(F.min("id").alias("low"))
        first = staged(member.join(low.hint("merge"), "component").where(F.col("id").eqNullSafe(F.col("low"))).select("component", "key"), "first")
        tied = first.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        texts = staged(first.join(tied.hint("merge"), "component"), "tied").join(rows.select("key", "text").distinct().hint("merge"), "key")
        chosen = first.join(tied.hint("merge"), "component", "left_anti").unionByName(texts.groupBy("component").agg(F.min(F.struct("text", "key")).alias("least")).select("component", "least.key"))
        chosen = staged(chosen.select("key"), "chosen")
        goes = member.join(chosen.hint("merge"), "key", "left_anti").select("key", F.lit(False).alias("again"))
        return goes.unionByName(member.join(chosen.hint("merge"), "key", "left_semi").where("copies > 1").select("key", F.lit(True).alias("again")))

    told_of = in_full(spark, "decided", decided)
    told = perhaps_in(docs.select(key, _packed(docs)), bitmap_of(told_of, "key"), "key")
    asked = told.where("perhaps").join(told_of.hint("merge"), "key", "left")
    stays = told.where("not perhaps").select("document").unionByName(asked.where("again is null").select("document"))
    return stays.unionByName(asked.where("again").dropDuplicates(["key"]).select("document")).select("document.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def contaminated() -> DataFrame:
        found = decontaminate.decontaminate(docs.select("text", _content("text")), table(spark, sf_dir, "benchmark"), keep=("key",))
        return found.where("contaminated").select("key").distinct()

    rows = docs.select(_content("text"), _packed(docs))
    return without(rows, in_full(spark, "contaminated", contaminated), "key").select("document.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Packing is a greedy online algorithm and has no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:  # never the input itself
            discard(before, spark)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
