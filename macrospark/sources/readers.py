"""Reading landed observations (SRC1-SRC6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from macrospark.columns import KEY, ORDER, VALUE, Names, finite, names, q
from macrospark.constants import CATALOG, OBSERVATION_START
from macrospark.functions.scalar import parse_date
from macrospark.operators.clean import blank_tokens, to_number

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("realtime_start", T.StringType()),
        T.StructField("realtime_end", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])

RAW_CSV_SCHEMA = "realtime_start date, realtime_end date, date date, value string"


def read_payloads(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """SRC1: provider payloads, one file (or line) per series, as (series_id, date,
    value) with the value still text. The series is the file's name unless the payload
    itself carries `series_id`."""
    schema = T.StructType([T.StructField("series_id", T.StringType()), *PAYLOAD_SCHEMA.fields])
    raw = spark.read.schema(schema).json(path, multiLine=multiline)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return (raw.select(F.coalesce("series_id", named).alias(KEY), F.explode("observations").alias("o"))
            .select(KEY, parse_date(F.col("o.realtime_start")).alias("realtime_start"),
                    parse_date(F.col("o.date")).alias(ORDER), F.col("o.value").alias(VALUE)))


def read_csv(spark: SparkSession, path: str, schema: str = RAW_CSV_SCHEMA) -> DataFrame:
    """SRC2: CSV with header and a given schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True, dateFormat="yyyy-MM-dd", enforceSchema=False)


def since(df: DataFrame, start: str = OBSERVATION_START, order: str = ORDER) -> DataFrame:
    """SRC3: lower bound on the date, as a range the scan can push down."""
    return df.filter(q(order) >= F.lit(start).cast(df.schema[order].dataType))


def numeric(c: Column, tokens: tuple[str, ...] = (".",)) -> Column:
    """Observation text to a clean double: tokens, bad text and non-finite to null."""
    return finite(to_number(blank_tokens(c, tokens)))


def catalog(spark: SparkSession, entries: Mapping[str, str] = CATALOG) -> DataFrame:
    """SRC4: series id -> indicator."""
    return spark.createDataFrame(list(entries.items()), f"{KEY} string, indicator string")


def with_indicator(df: DataFrame, entries: Mapping[str, str] = CATALOG) -> DataFrame:
    """SRC4: indicator of each row's series. The catalog is a short literal table, so
    the join is a broadcast of known size."""
    return df.join(F.broadcast(catalog(df.sparkSession, entries)), KEY, "inner")


def latest_values(
    df: DataFrame, key: Names = KEY, order: Names = ORDER, value: str = VALUE, text: bool = True
) -> DataFrame:
    """SRC5: value of the newest observation per series; null when it is not a number.
    `order` may list tie breakers."""
    c = numeric(q(value)) if text else q(value)
    at = F.struct(*[q(o) for o in names(order)])
    return df.groupBy(*[q(k) for k in names(key)]).agg(
        F.max(q(names(order)[0])).alias(names(order)[0]), F.max_by(c, at).alias(value))


def resolve_vintages(
    df: DataFrame, key: Names = (KEY, ORDER), value: str = VALUE, vintage: Names = "realtime_start"
) -> DataFrame:
    """SRC6: one value per (series, date), from the newest vintage. `vintage` may list
    tie breakers."""
    at = F.struct(*[q(v) for v in names(vintage)])
    first = names(vintage)[0]
    return df.groupBy(*[q(c) for c in names(key)]).agg(
        F.max_by(q(value), at).alias(value), F.max(q(first)).alias(first))
