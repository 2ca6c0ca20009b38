"""Writing panels, exports and parameters (SNK1-SNK4). SNK5 is in learning.models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, q


def write_panel(
    df: DataFrame, path: str, fmt: str = "parquet", partition: Names = (), mode: str = "overwrite"
) -> None:
    """SNK1. Partition by a column with few values only; rows are first gathered by it. Spark cuts a hot value into as many tasks as
    its bytes need, and puts small values together."""
    cols = names(partition)
    if cols:
        df = df.hint("rebalance", *[q(c) for c in cols])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.save(path)


def columnar_export(
    df: DataFrame, columns: Sequence[str], key: Names = (), order: str = ORDER
) -> DataFrame:
    """SNK2: one row per key with parallel arrays in date order, nulls as 0. For
    period-grained panels: an array holds one entry per period."""
    point = F.struct(q(order).alias("_d"), *[F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(f"_{i}")
                                             for i, c in enumerate(columns)])
    packed = df.groupBy(*[q(c) for c in names(key)]).agg(F.array_sort(F.collect_list(point)).alias("_p"))

    def field(i: int) -> Column:
        return F.transform("_p", lambda p: p[f"_{i}"])

    return packed.select(*[q(c) for c in names(key)],
                         F.transform("_p", lambda p: F.date_format(p["_d"], "yyyy-MM-dd")).alias("dates"),
                         *[field(i).alias(c) for i, c in enumerate(columns)])


def snapshot_map(latest: DataFrame, label: str = KEY, value: str = VALUE, updated_at: Column | None = None) -> DataFrame:
    """SNK3: one row with a label -> value map. The input has one row per label (see
    `latest_values`), so the map is as long as the label list."""
    entries = F.array_sort(F.collect_list(F.struct(q(label).alias("key"), q(value).alias("value"))))
    stamp = updated_at if updated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return latest.agg(F.map_from_entries(entries).alias("values")).withColumn("updated_at", stamp)


def save_params(params: DataFrame, path: str) -> None:
    """SNK4: parameter table, one row per series."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
