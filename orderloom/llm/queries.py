"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, licenses, lines, middle, mix, personal, separators, shard, simhash, toxicity, trie, wrapper
from .common import table


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.words_taken(table(spark, sf_dir, "documents"))


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.tag_documents(table(spark, sf_dir, "documents"))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op10_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_middle_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_wrapper_induction, op2_separator_scan, op3_multi_index_hashing, op4_golden_mix, op5_semi_markov_pii, op6_license_join, op7_simhash_anchors,
    op8_decontaminate, op9_shard_shuffle, op10_toxicity_gru, op11_middle_scatter, op12_conversation_trie, op13_line_dedup,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def statements() -> dict[str, str]:
    return {
        "op4_golden_mix": mix.words_taken_sql(),
        "op11_middle_scatter": middle.digests_sql(),
        "op12_conversation_trie": trie.rebuilt_trie_sql(),
        "op13_line_dedup": lines.kept_digests_sql(),
    }
