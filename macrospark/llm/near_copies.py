"""Near copies: of texts whose sets of five-word runs are 0.8 alike or more one stays.

Chains of links make a group. The first links come from SimHash fingerprints of the sets through the segment-popcount grid (`simhash`), each confirmed by
the exact sets. That does not reach all: at a similarity of 0.8 two fingerprints differ by some 10 of 64 bits, and a grid for that distance has more cells
than any budget. So the set join (`set_join`) goes on with the pairs these links leave apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from macrospark.llm import set_join, simhash
from macrospark.llm.common import kept, matching, same_rows_once


def fingerprint_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between similar sets whose fingerprints are equal or meet in the grid; `rows` are the sketches of `docs` with fingerprints. Of
    the sets of one fingerprint the first stands for all and is compared with each."""
    prints = rows.where("size > 0").select("set", "fp").distinct()
    first = kept(prints.groupBy("fp").agg(F.min("set").alias("set")), "near-prints")
    of = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("set").alias(name))
    equal = prints.withColumnRenamed("set", "b").join(of("fp", "a"), "fp").where("a <> b").select("a", "b")
    close = simhash.links(first.select("fp")).toDF("x", "y").join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
    return kept(set_join.similar(docs, kept(equal.unionByName(close), "near-pairs")), "near-links")


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id, mark (text_mark) and times (how many rows have both) of the documents that stay.

    Of each group the row with the smallest doc_id, then mark, stays; one without doc_id comes last. Texts without words are a group."""
    sets, heavy = set_join.sketches(docs, prints=True)
    near = set_join.links(docs, sets, heavy, fingerprint_links(docs, sets))
    rows = set_join.classes_of(sets, near).select("doc_id", "mark", F.coalesce("root", F.lit(0)).alias("root"), F.col("root").isNull().alias("blank"))
    byrow = rows.groupBy("root", "blank", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "times")).alias("head")
    return byrow.groupBy("root", "blank").agg(head).select("head.doc_id", "head.mark", "head.times")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they were; of rows alike in doc_id and text one stays."""
    stay = kept(survivors(docs), "near-stay")
    once = matching(docs, stay.where("times = 1"))
    return once.unionByName(same_rows_once(matching(docs, stay.where("times > 1"))))
