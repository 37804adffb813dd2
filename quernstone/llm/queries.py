"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import block_anchors, decontaminate, jaccard, secret_ledger, warc
from quernstone.llm.staging import fresh_dir, table


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.token_orc import token_digests, write_token_orc

    path = fresh_dir(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_digests(spark, path)


def op2_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.fst_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op3_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"), min_revisit_bytes=0)
    return warc.read_archives(spark, manifest)


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), percent=80, width=5)


def op5_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.deduplicate(table(spark, sf_dir, "documents"), window=35)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.scan_versions(table(spark, sf_dir, "documents")))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_transducer_counts": op2_transducer_counts,
    "op3_warc_reader": op3_warc_reader,
    "op4_grouped_prefix_join": op4_grouped_prefix_join,
    "op5_skip_chain_crf": op5_skip_chain_crf,
    "op6_block_anchors": op6_block_anchors,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_positional_index": op8_positional_index,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLES: dict[str, str] = {
    "op3_warc_reader": warc.ORACLE,
    "op4_grouped_prefix_join": jaccard.ORACLE,
    "op6_block_anchors": block_anchors.ORACLE,
    "op7_secret_ledger": secret_ledger.ORACLE,
    "op8_positional_index": decontaminate.ORACLE,
}
