"""Series and panels derived from the given tables, each with the SQL that defines
the same rows. Everything is folded to one row per (series, period) in the first
aggregation, map-side first; that bounds every later window by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import ordered
from macrospark.constants import INDICATORS, TARGET_HORIZONS
from macrospark.operators.joins import widen
from macrospark.plans.catalogue import nudge

# Series of the orders table and their panel columns, in order of urgency.
PRIORITIES = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "unspecified", "5-LOW": "low",
}
MEMBERS = list(PRIORITIES.values())

# Split that leaves about a quarter of the months for testing.
SPLIT = "2000-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def month(name: str):
    return F.trunc(F.col(name), "month").alias("date")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order value per priority: five long series."""
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), month("o_orderdate"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value")))


def part_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue per part: very many series."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("series_id"), month("l_shipdate"))
            .agg(F.round(F.sum("l_extendedprice"), 2).alias("value")))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The five order series as columns, one row per month."""
    return widen(obs(spark, sf), PRIORITIES)


def event_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events as observations: few series with unbounded rows."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), "event_id", "ts", F.to_date("ts").alias("date"), "value")


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events where some readings are missing."""
    return event_obs(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 >= 3, F.col("value")))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text readings with missing tokens and infinities."""
    text = (F.when(F.col("event_id") % 17 == 0, ".").when(F.col("event_id") % 23 == 0, "inf")
            .otherwise(F.col("value").cast("string")))
    return event_obs(spark, sf).withColumn("value", text)


def vintages(spark: SparkSession, sf: str) -> DataFrame:
    """Order values as revisions: the later the order's number, the later the vintage."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("series_id"), month("o_orderdate"), F.col("o_orderkey").alias("revision"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("realtime_start"),
        F.col("o_totalprice").alias("value"))


def economy(spark: SparkSession, sf: str) -> DataFrame:
    """Wide monthly panel per supplier with the twelve indicators and the base target.
    Rates and indices are shares and means of line items, the others are totals."""
    price, qty, disc, tax = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "discount", "tax"))
    net = price * (1 - disc)
    measures = {
        "recession_probability": 100 * F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)),
        "1_year_rate": 100 * F.avg(tax),
        "3_months_rate": 100 * F.avg(disc),
        "6_months_rate": 100 * F.max(disc),
        "CPI": F.sum(price) / F.sum(qty) / 10,
        "INDPRO": F.sum(qty),
        "10_year_rate": 100 * F.max(tax),
        "share_price": F.avg(price) / 100,
        "unemployment_rate": 100 * F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)),
        "PPI": F.sum(net) / F.sum(qty) / 10,
        "OECD_CLI_index": 100 * F.sum(net) / F.sum(price),
        "CSI_index": 100 * F.avg(F.when(qty >= 25, 1.0).otherwise(0.0)),
        "gdp_per_capita": F.sum(price) / 100,
    }
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"), month("l_shipdate"))
            .agg(*[F.round(m + F.lit(nudge(6)), 6).alias(n) for n, m in measures.items()]))


def economy_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The economy panel with the base target at the three horizons."""
    w = ordered("series_id", "date")
    return economy(spark, sf).withColumns(
        {t: F.lead("recession_probability", k).over(w) for t, k in TARGET_HORIZONS.items()})



# --- the same in SQL ------------------------------------------------------------

OBS = """obs AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""

PART_OBS = """obs AS (SELECT l_partkey AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
 round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2)"""

PANEL = OBS + ", panel AS (SELECT date, " + ", ".join(
    f"max(CASE WHEN series_id = '{s}' THEN value END) AS {c}" for s, c in PRIORITIES.items()
) + " FROM obs GROUP BY date)"

EVENTS = """ev AS (SELECT event_type AS series_id, event_id, ts, CAST(ts AS DATE) AS date, value FROM events)"""

GAPPY = """ev AS (SELECT event_type AS series_id, event_id, ts, CAST(ts AS DATE) AS date,
 CASE WHEN event_id % 7 >= 3 THEN value END AS value FROM events)"""

DIRTY = """dirty AS (SELECT event_type AS series_id, event_id, ts, CAST(ts AS DATE) AS date,
 CASE WHEN event_id % 17 = 0 THEN '.' WHEN event_id % 23 = 0 THEN 'inf' ELSE CAST(value AS VARCHAR) END AS value
 FROM events)"""

VINTAGES = """vint AS (SELECT o_custkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 o_orderkey AS revision, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS realtime_start,
 o_totalprice AS value FROM orders)"""

_MEASURES = {
    "recession_probability": "100 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END)",
    "1_year_rate": "100 * avg(l_tax)",
    "3_months_rate": "100 * avg(l_discount)",
    "6_months_rate": "100 * max(l_discount)",
    "CPI": "sum(l_extendedprice) / sum(l_quantity) / 10",
    "INDPRO": "sum(l_quantity)",
    "10_year_rate": "100 * max(l_tax)",
    "share_price": "avg(l_extendedprice) / 100",
    "unemployment_rate": "100 * avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0 END)",
    "PPI": "sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) / 10",
    "OECD_CLI_index": "100 * sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)",
    "CSI_index": "100 * avg(CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE 0.0 END)",
    "gdp_per_capita": "sum(l_extendedprice) / 100",
}

ECONOMY = ("econ AS (SELECT l_suppkey AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, "
           + ", ".join(f'round({m} + {nudge(6):e}::DOUBLE, 6) AS "{n}"' for n, m in _MEASURES.items())
           + " FROM lineitem GROUP BY 1, 2)")

ECONOMY_LONG = ECONOMY + ", elong AS (" + " UNION ALL ".join(
    f"SELECT series_id, date, '{c}' AS indicator, \"{c}\" AS value FROM econ" for c in INDICATORS) + ")"
