"""Small helpers the operators share: words, let-bindings, portable hashes, running sums without a hot window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from macrospark.session import cut_lineage, scratch_path

#: What separates words: a run of ASCII blanks. A word is anything else.
GAP = r"[\x20\x09-\x0D]+"

#: Bits in `digest_number`.
DIGEST_BITS = 52


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions the session was sized with; it grows with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of words of a whole text; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` worked out once per row. A value named twice, or inside a lambda,
    would otherwise be pasted in and worked out again at each use."""
    return F.transform(F.array(value), body)[0]


def digest_number(*parts: Column | str) -> Column:
    """52 bits of MD5 as a long: the same number in any SQL engine."""
    joined = F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def digest_sql(text: str) -> str:
    """`digest_number` in DuckDB, of a text expression."""
    return f"CAST('0x' || substr(md5({text}), 1, {DIGEST_BITS // 4}) AS BIGINT)"


def key_text(key: Column) -> Column:
    """A key as text, with a text of its own for null."""
    return F.coalesce(key.cast("string"), F.lit("<null>"))


def text_mark(text: Column) -> Column:
    """A number that tells texts apart; null has one of its own. Beside doc_id it names a row where ids are missing or repeated."""
    return F.xxhash64(text.isNull(), text)


def same_row(df: DataFrame, doc_id: str = "_id", mark: str = "_mark") -> Column:
    """Whether a row of documents `df` has this doc_id (which may be null) and text_mark."""
    return df["doc_id"].eqNullSafe(F.col(doc_id)) & (text_mark(df["text"]) == F.col(mark))


def matching(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents that `rows` (doc_id, mark: a text_mark) names, or does not name ("left_anti"), with their own columns. Each row is met by doc_id and
    text, so rows without doc_id or of one doc_id stand for themselves; `docs` may have columns of any names."""
    named = rows.select(F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark")).distinct().alias("__named")
    met = F.col("__docs.doc_id").eqNullSafe(F.col("__named.__doc_id")) & (text_mark(F.col("__docs.text")) == F.col("__named.__mark"))
    return docs.alias("__docs").join(named, met, how)


def same_rows_once(docs: DataFrame) -> DataFrame:
    """One of the rows that are alike in doc_id and text; which one, where other columns differ, is open."""
    return docs.dropDuplicates(["doc_id", "text"])


def before_in_group(df: DataFrame, group: Sequence[str], rank: str, ties: Sequence[str],
                    sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of `sums`, the total over the rows that stand before a row in its group.

    Rows stand in the order of `rank` (a `digest_number`, so evenly spread) and then `ties`. A group may hold
    a third of all rows: it is cut into as many ranges of `rank` as the session has shuffle
    partitions, each range is summed alone, and the ranges' totals (one small row each) are
    summed in turn. The result does not depend on the number of ranges. Group columns must not be null."""
    n = tasks(df.sparkSession)
    part = F.floor(F.col(rank) * F.lit(n / float(1 << DIGEST_BITS))).cast("int")
    rows = df.withColumn("_part", part)
    keys = [*group, "_part"]
    inside = Window.partitionBy(*keys).orderBy(rank, *ties).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    bases = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{k}").over(across), F.lit(0)).alias(f"_b_{k}") for k in sums])
    placed = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{k}") for k, c in sums.items()])
    out = placed.join(bases, keys)
    return out.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps do not work it out again,
    a lost executor costs a re-read, and Spark knows the true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


__all__ = ["GAP", "DIGEST_BITS", "before_in_group", "cut_lineage", "digest_number", "digest_sql", "kept", "key_text",
           "let", "matching", "same_row", "same_rows_once", "table", "tasks", "text_mark", "words"]
