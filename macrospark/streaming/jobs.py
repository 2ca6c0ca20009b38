"""Incremental jobs with Structured Streaming (STR1-STR5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from macrospark.columns import KEY, ORDER, VALUE, Names, names, q
from macrospark.operators.decompose import flag_values
from macrospark.sources.readers import resolve_vintages


def landed_files(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int = 100
) -> DataFrame:
    """Stream over a folder of landed files, with a bound on files per batch."""
    return (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", f"*.{fmt}").load(path))


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """All available data once, or a fixed interval such as "6 hours"."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def refresh(
    stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """STR1: run `rebuild` on each batch of new files. Progress is in the checkpoint
    folder, so a restart neither skips nor repeats a file; `rebuild` must be
    idempotent per batch id (see `upsert_vintages`)."""
    writer = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return triggered(writer, every).start()


def rebuild_months(
    source: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], target: str, ts: str
) -> Callable[[DataFrame, int], None]:
    """STR1: batch function that rebuilds a gold table by month. Only the months that
    occur in the batch are read again from `source`, built and overwritten, so a
    refresh costs what changed; a replayed batch writes the same months again.
    `build` must keep a column `month` (first day)."""
    def rebuild(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(F.trunc(q(ts).cast("date"), "month").alias("month")).distinct()
        rows = source().withColumn("month", F.trunc(q(ts).cast("date"), "month")).join(touched, "month", "left_semi")
        (build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(target))

    return rebuild


def land_updates(target: str) -> Callable[[DataFrame, int], None]:
    """Batch function for update mode: each batch's changed rows in a folder of their own."""
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return land


def read_updates(spark: SparkSession, target: str, key: Names) -> DataFrame:
    """Latest landed row of every key."""
    landed = spark.read.parquet(target)
    rest = [c for c in landed.columns if c not in [*names(key), "batch"]]
    picked = landed.groupBy(*[q(c) for c in names(key)]).agg(F.max_by(F.struct(*[q(c) for c in rest]), "batch").alias("_row"))
    return picked.select(*[q(c) for c in names(key)], *[F.col("_row")[c].alias(c) for c in rest])


def land_monthly_sums(target: str, ts: str, key: Names = KEY, value: str = VALUE) -> Callable[[DataFrame, int], None]:
    """STR2: batch function that lands sum and count per series and month of each batch in
    a folder of its own. No state is kept, so a month takes readings however late they
    come, and a replayed batch overwrites its own sums only."""
    def land(batch: DataFrame, batch_id: int) -> None:
        month = F.date_trunc("month", q(ts).cast("timestamp")).alias("month_start")
        sums = batch.groupBy(*[q(c) for c in names(key)], month).agg(
            F.sum(q(value)).alias("_sum"), F.count(q(value)).alias("_n"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return land


def read_monthly_means(spark: SparkSession, target: str, key: Names = KEY, value: str = VALUE) -> DataFrame:
    """STR2: monthly means over all landed batches; null for a month without values."""
    landed = spark.read.parquet(target).groupBy(*[q(c) for c in names(key)], "month_start")
    return landed.agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias(value), F.sum("_n").alias("n"))


def append_vintages(
    target: str, key: Names = (KEY, ORDER), value: str = VALUE, vintage: str = "realtime_start"
) -> Callable[[DataFrame, int], None]:
    """STR3: batch function that lands the newest vintage per key of each batch in a
    folder of its own. Work per batch is that of the batch, not of the table, and a
    replayed batch overwrites its own folder only."""
    def land(batch: DataFrame, batch_id: int) -> None:
        resolve_vintages(batch, key, value, vintage).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return land


def read_current(
    spark: SparkSession, target: str, key: Names = (KEY, ORDER), value: str = VALUE, vintage: str = "realtime_start"
) -> DataFrame:
    """STR3: the table as of now: the newest vintage per key over all landed batches."""
    landed = spark.read.parquet(target)
    return resolve_vintages(landed, key, value, [vintage, "batch"])


def compact_vintages(spark: SparkSession, target: str, output: str, **columns: Names) -> None:
    """STR3: fold all batches into one (batch 0 of `output`), to run now and then."""
    read_current(spark, target, **columns).write.mode("overwrite").parquet(f"{output}/batch=0")


def score_stream(stream: DataFrame, bounds: DataFrame, key: Names = KEY, value: str = VALUE) -> DataFrame:
    """STR4: anomaly flag per arriving row against static bounds (stateless join)."""
    return flag_values(stream, bounds, key, value)


def latest_stream(stream: DataFrame, ts: str, key: Names = KEY, value: str = VALUE, ties: Names = ()) -> DataFrame:
    """STR5: newest value per series as running state; use update or complete mode. Of
    readings of one time the largest in `ties` counts, and then the largest value."""
    newest = F.max(F.struct(q(ts), *[q(c) for c in names(ties)], q(value).alias("_value")))
    picked = stream.groupBy(*[q(c) for c in names(key)]).agg(newest.alias("_last"))
    return picked.select(*[q(c) for c in names(key)], F.col("_last")[ts].alias(ts), F.col("_last._value").alias(value))
