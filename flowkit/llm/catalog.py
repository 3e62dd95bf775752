"""The corpus queries and their SQL. `__spark_entry__` adds them to the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.llm import (
    bpe, katz, licenses, mixing, packing, pages, simhash, suffixes, toxicity, turns, vectors, whitening,
)
from flowkit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_bytes(table(spark, sf_dir, "documents"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(table(spark, sf_dir, "conversations"))


def op12_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


for _query in (
    op1_retrieval_packing, op2_mixing_tree, op3_line_blocks, op4_simhash_trie, op5_toxicity_ftrl, op6_suffix_arrays,
    op7_katz_backoff, op8_pivot_top_k, op9_multi_index, op10_license_windows,
    op11_turn_repair, op12_pair_index_bpe, op13_qd_whitening,
):
    QUERIES[_query.__name__] = _query
SQL["op2_mixing_tree"] = mixing.TAKEN_SQL
SQL["op10_license_windows"] = licenses.scan_sql()
