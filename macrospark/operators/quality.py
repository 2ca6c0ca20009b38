"""Data-quality rules (DQ1-DQ8). Each returns rows (rule, column, violations, passed);
rules over values are columns of one aggregation, whatever their number."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.columns import Names, names, q
from macrospark.functions.scalar import parse_date
from macrospark.operators.clean import to_number

RULE_SCHEMA = "rule string, column string, violations bigint, passed boolean"

# Value ranges per kind of column. Fixed values.
RANGES = {"probability": (0.0, 1.0), "percent": (0.0, 100.0), "rate": (0.0, 20.0)}


def _rows(df: DataFrame, counts: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """All rule counts from one pass, turned into one row per rule."""
    one = df.agg(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"),
                            F.coalesce(n.cast("long"), F.lit(0)).alias("violations")).alias(f"_{i}")
                   for i, (r, c, n) in enumerate(counts)])
    return (one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(counts))])))
            .withColumn("passed", F.col("violations") == 0))


def _from_driver(df: DataFrame, rows: Iterable[tuple[str, str, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(r, c, n, n == 0) for r, c, n in rows], RULE_SCHEMA)


def check_columns(df: DataFrame, expected: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """DQ1: ordered column list, and at least one column per required pattern."""
    rows = [("columns_match_ordered_list", "*", int(list(df.columns) != list(expected)))]
    rows += [("has_pattern", p, int(not any(p in c for c in df.columns))) for p in patterns]
    return _from_driver(df, rows)


def check_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """DQ2."""
    kinds = dict(df.dtypes)
    return _from_driver(df, [("column_type", c, int(kinds.get(c) != t)) for c, t in expected.items()])


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """DQ3: closed ranges; None leaves a side open. Nulls are not violations here."""
    def bad(c: str, lo: float | None, hi: float | None) -> Column:
        test = F.lit(False)
        if lo is not None:
            test = test | (q(c) < lo)
        if hi is not None:
            test = test | (q(c) > hi)
        return F.count_if(test)

    return _rows(df, [("in_range", c, bad(c, lo, hi)) for c, (lo, hi) in ranges.items()])


def check_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ3, strict: values above 0."""
    return _rows(df, [("positive", c, F.count_if(q(c) <= 0)) for c in columns])


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ4."""
    return _rows(df, [("not_null", c, F.count_if(q(c).isNull())) for c in columns])


def check_unique(df: DataFrame, key: Names) -> DataFrame:
    """DQ4: rows beyond the first of each key. Grouped by the whole key, so a hot
    leading column does not gather in one task."""
    extra = df.groupBy(*[q(c) for c in names(key)]).count()
    return _rows(extra, [("unique", ",".join(names(key)), F.sum(F.col("count") - 1))])


def check_duplicates(df: DataFrame) -> DataFrame:
    """DQ5: repeated whole rows."""
    extra = df.groupBy(*[q(c) for c in df.columns]).count()
    return _rows(extra, [("no_duplicate_rows", "*", F.sum(F.col("count") - 1))])


def check_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ5: no infinities (NaN is a missing value, not a violation)."""
    inf = F.lit(float("inf"))
    return _rows(df, [("no_infinity", c, F.count_if(F.abs(q(c)) == inf)) for c in columns])


def scale_class(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ6: normalized (mean near 0, std near 1), scaled (within [0, 1]) or raw."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.avg(q(c)).alias("mean"), F.stddev_samp(q(c)).alias("std"),
                            F.min(q(c)).cast("double").alias("min"), F.max(q(c)).cast("double").alias("max")).alias(f"_{i}")
                   for i, c in enumerate(columns)])
    long = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    normal = (F.abs("mean") < 0.1) & (F.abs(F.col("std") - 1) < 0.1)
    return long.withColumn("scale", F.when(normal, "normalized")
                           .when((F.col("min") >= 0) & (F.col("max") <= 1), "scaled").otherwise("raw"))


def check_horizon_correlation(df: DataFrame, columns: Sequence[str], minimum: float = 0.3) -> DataFrame:
    """DQ7: mean pairwise correlation of the probability columns, undefined ones left out."""
    pairs = [F.corr(q(a), q(b)) for a, b in combinations(columns, 2)]
    one = df.agg(F.array_compact(F.array(*[F.nanvl(p, F.lit(None).cast("double")) for p in pairs])).alias("_c"))
    mean = F.try_divide(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x), F.size("_c"))
    return one.select(mean.alias("mean_correlation")).withColumn(
        "passed", F.coalesce(F.col("mean_correlation") > minimum, F.lit(False)))


def parse_records(df: DataFrame, date: str = "date", value: str = "value", sentinel: float = -999.0) -> DataFrame:
    """DQ8: malformed records become nulls. Adds parsed_date, parsed_value and the
    reason of the first defect (null for a good record)."""
    d, v = parse_date(q(date)), to_number(q(value))
    inf = F.lit(float("inf"))
    reason = (F.when(q(date).isNull(), "missing_date").when(d.isNull(), "bad_date")
              .when(q(value).isNull(), "missing_value").when(F.trim(q(value)) == "", "empty_value")
              .when(F.trim(q(value)) == ".", "missing_token").when(v.isNull(), "bad_value")
              .when(F.isnan(v) | (F.abs(v) == inf), "non_finite").when(v == sentinel, "sentinel"))
    good = F.when(~F.isnan(v) & (F.abs(v) != inf) & (v != sentinel), v)
    return df.withColumns({"parsed_date": d, "parsed_value": good, "reject_reason": reason})


def reject_counts(parsed: DataFrame) -> DataFrame:
    """DQ8: number of records per defect."""
    return (parsed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("records"), F.count("parsed_value").alias("usable_values")))


def run_rules(*reports: DataFrame) -> DataFrame:
    """All reports as one frame."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
