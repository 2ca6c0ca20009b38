"""Queries that run a stream over the given files to its end and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.operators.clean import split_at
from macrospark.operators.decompose import anomaly_bounds
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import table
from macrospark.session import scratch_path
from macrospark.streaming import jobs as J
from macrospark.streaming.levels import compact, read_compacted

Spark = SparkSession

#: A table of very many files is taken in batches of so many.
FILES_PER_BATCH = 1000


def _stream(spark: Spark, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf))


def _events(spark: Spark, sf: str) -> DataFrame:
    return _stream(spark, sf, "events").withColumnRenamed("event_type", "series_id")


def _finish(stream: DataFrame, spark: Spark, batch, mode: str = "append") -> None:
    job = (stream.writeStream.outputMode(mode).foreachBatch(batch).trigger(availableNow=True)
           .option("checkpointLocation", scratch_path(spark, "progress")).start())
    job.awaitTermination()


@query("str1_refresh", f"""SELECT {d("date_trunc('month', o_orderdate)", 'month')}, o_orderpriority AS series_id, {r('sum(o_totalprice)', 'value', 2)}, count(*) AS n
 FROM orders GROUP BY 1, 2""", 2)
def _refresh(spark: Spark, sf: str) -> DataFrame:
    target = scratch_path(spark, "gold")

    def gold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("month", q("o_orderpriority").alias("series_id")).agg(
            F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))

    rebuild = J.rebuild_months(lambda: table(spark, sf, "orders"), gold, target, "o_orderdate")
    J.refresh(_stream(spark, sf, "orders"), rebuild, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.schema("series_id string, value double, n bigint, month date").parquet(target)


@query("str2_monthly_mean", f"""SELECT event_type AS series_id, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS month_start, {r('avg(value)', 'value')}, count(value) AS n
 FROM events GROUP BY 1, 2""")
def _monthly(spark: Spark, sf: str) -> DataFrame:
    target = scratch_path(spark, "means")
    _finish(_events(spark, sf), spark, J.land_monthly_sums(target, "ts"))
    return J.read_monthly_means(spark, target)


_UPSERT = f"""WITH x AS (SELECT o_custkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_totalprice AS value, o_orderkey AS revision,
 row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey DESC) AS rn FROM orders)
 SELECT series_id, {d()}, {r('value')}, revision FROM x WHERE rn = 1"""


@query("str3_vintage_upsert", _UPSERT)
def _upsert(spark: Spark, sf: str) -> DataFrame:
    target = scratch_path(spark, "vintages")
    rows = _stream(spark, sf, "orders").select(
        q("o_custkey").alias("series_id"), F.trunc("o_orderdate", "month").alias("date"),
        q("o_totalprice").alias("value"), q("o_orderkey").alias("revision"))
    _finish(rows, spark, J.append_vintages(target, vintage="revision"))
    return J.read_current(spark, target, vintage="revision")


@query("str3_compacted_upsert", _UPSERT)
def _compacted(spark: Spark, sf: str) -> DataFrame:
    """The same in twelve batches by quarter, with compactions in between."""
    target, quarters = scratch_path(spark, "levels"), 12
    rows = table(spark, sf, "orders").select(
        q("o_custkey").alias("series_id"), F.trunc("o_orderdate", "month").alias("date"),
        q("o_totalprice").alias("value"), q("o_orderkey").alias("revision"))
    place = F.pmod(F.quarter("date") + 4 * F.year("date"), F.lit(quarters))
    land = J.append_vintages(target, vintage="revision")
    for batch in range(quarters):
        land(rows.filter(place == quarters - 1 - batch), batch)
        if batch % 4 == 3:
            compact(spark, target, 3, vintage="revision")
    return read_compacted(spark, target, vintage="revision")


@query("str4_anomaly_scoring", f"""WITH bd AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
 SELECT event_id, {r('value')}, coalesce(NOT (value BETWEEN m - 3 * s AND m + 3 * s), true)::INTEGER::BIGINT AS anomaly FROM events LEFT JOIN bd USING (event_type)""")
def _scoring(spark: Spark, sf: str) -> DataFrame:
    history = table(spark, sf, "events").withColumnRenamed("event_type", "series_id")
    bounds = anomaly_bounds(split_at(history, "2024-01-15", "ts")[0], "value")
    target = scratch_path(spark, "flags")
    stream = _events(spark, sf).select("series_id", "event_id", "value")
    _finish(J.score_stream(stream, bounds), spark, J.land_updates(target))
    return spark.read.parquet(target).select("event_id", "value", "anomaly")


@query("str5_latest_values", f"""SELECT event_type AS series_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, {r('max(value) FILTER (WHERE ts = last)', 'value')} FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS last FROM events) GROUP BY 1""")
def _latest(spark: Spark, sf: str) -> DataFrame:
    target = scratch_path(spark, "latest")
    _finish(J.latest_stream(_events(spark, sf), "ts"), spark, J.land_updates(target), "update")
    return J.read_updates(spark, target, "series_id")
