"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruzi.llm import media, mixing, packing, pii, quality_model, quality_rules, secrets, sharding, simhash, url_filters
from ruzi.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(found.fp).alias("fingerprint"), "component_id")


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op10_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_tree_quality": op1_tree_quality,
    "op2_curriculum": op2_curriculum,
    "op3_sampled_splitters": op3_sampled_splitters,
    "op4_sum_of_squares": op4_sum_of_squares,
    "op5_lossless_webp": op5_lossless_webp,
    "op6_simhash_trees": op6_simhash_trees,
    "op7_pii_anchors": op7_pii_anchors,
    "op8_host_rules": op8_host_rules,
    "op9_linked_secrets": op9_linked_secrets,
    "op10_redirect_equivalence": op10_redirect_equivalence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_curriculum": mixing.SQL,
    "op3_sampled_splitters": sharding.SQL,
    "op8_host_rules": quality_rules.SQL,
    "op10_redirect_equivalence": url_filters.SQL,
}
