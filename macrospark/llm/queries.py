"""The operators applied to whole tables: one query for each, with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from macrospark.llm import decontamination, filter_audit, language, licenses, line_dedup, mixing, pii, quality_rules, set_join, sharding, simhash, substring_dedup, vector_codes
from macrospark.llm.common import table
from macrospark.plans.catalogue import Query

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = Query(run, sql)
        return run

    return add


@query("op2_line_windows", line_dedup.digest_oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


@query("op5_source_mix", mixing.digest_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


@query("op6_rendezvous_shards", sharding.digest_oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


@query("op3_repeated_windows", substring_dedup.digest_oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


@query("op7_segment_popcount")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op9_decision_list")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_edit_windows")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query("op4_licence_paragraphs")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


@query("op8_language_evidence")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op11_partenum_join")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.digest(table(spark, sf_dir, "documents"))


@query("op12_grid_codes", vector_codes.digest_oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


@query("op13_posting_lists", filter_audit.digest_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
