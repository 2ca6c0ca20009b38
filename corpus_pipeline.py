"""The corpus pipeline: five stages over the documents, each an operator of macrospark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.llm import decontamination, mixing, near_copies, quality_rules, sharding
from macrospark.llm.common import kept, matching, table, text_mark


def _judged(docs: DataFrame, *columns: str) -> DataFrame:
    """What an operator needs of the documents, with the mark that tells rows apart where doc_id is missing or repeated. Other
    columns stay behind, so they may have any names."""
    return docs.select("doc_id", "text", *columns, text_mark(F.col("text")).alias("mark"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor a learned rule rejects, each row judged by its own text. Null, empty and blank texts go."""
    chosen = quality_rules.judge(_judged(docs), table(spark, sf_dir, "labels"), ["mark"]).where("kept")
    return matching(docs, chosen)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word runs are 0.8 alike or more, chains included, the one with the smallest doc_id; one
    without doc_id stays only where the group has no other. Texts without words are a group."""
    return near_copies.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item. Without items, and of texts without words, all stay."""
    return matching(docs, decontamination.contaminations(_judged(docs), table(spark, sf_dir, "benchmark")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix plays it: the words taken over its size, rounded. Rows alike in doc_id, text and source are played alike;
    texts without words are never played. A null source is a source."""
    played = mixing.mix(_judged(docs, "source"), carry=["mark"]).where("size > 0")
    times = played.groupBy(F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark"), F.col("source").alias("__source")).agg(
        F.round(F.sum("taken") / F.sum("size")).cast("int").alias("__times")).where("__times > 0").alias("__played")
    same = (F.col("__docs.doc_id").eqNullSafe(F.col("__played.__doc_id")) & (text_mark(F.col("__docs.text")) == F.col("__played.__mark"))
            & F.col("__docs.source").eqNullSafe(F.col("__played.__source")))
    return docs.alias("__docs").join(times, same).select("__docs.*", F.explode(F.sequence(F.lit(1), F.col("__played.__times"))).alias("__turn")).drop("__turn")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard, slot and the shard they would have if there were one more; columns of these names are replaced."""
    plain = docs.drop("shard", "slot", "grown_shard")
    return sharding.slots(sharding.assign(plain, [1.0] * 40, grown=[1.0]))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("source mix", mix), ("shards", shard)]

#: Chains of similar shingle sets and greedy rule learning are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
