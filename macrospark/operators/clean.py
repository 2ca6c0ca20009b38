"""Projections, predicates and filters (PRJ1-PRJ13, FLT1-FLT9)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, finite, names, ordered, q
from macrospark.constants import SPLIT_DATE, TARGETS

# Calendar words and their order. Fixed values.
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def name_value(df: DataFrame, indicator: str, value: str = VALUE) -> DataFrame:
    """PRJ1: give the value column its indicator name."""
    return df.withColumnRenamed(value, indicator)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """PRJ2."""
    return df.drop(*cols)


def to_number(c: Column) -> Column:
    """PRJ3: numeric coercion, unreadable text becomes null."""
    return c.try_cast("double")


def blank_tokens(c: Column, tokens: Iterable[str] = (".",)) -> Column:
    """PRJ4: missing-value tokens become null."""
    return F.when(~F.trim(c).isin(*tokens), c)


def null_non_finite(df: DataFrame, cols: Names | None = None) -> DataFrame:
    """PRJ5: NaN and infinities become null in the given (or all double) columns."""
    chosen = names(cols) if cols is not None else [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(q(c)) for c in chosen})


def zero_non_finite(df: DataFrame, cols: Names | None = None) -> DataFrame:
    """PRJ6: NaN, infinities and nulls become 0."""
    chosen = names(cols) if cols is not None else [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.coalesce(finite(q(c)), F.lit(0.0)) for c in chosen})


def sanitize_columns(df: DataFrame) -> DataFrame:
    """PRJ7: every run of characters outside letters, digits and _ becomes _."""
    return df.toDF(*[re.sub(r"[^A-Za-z0-9_]+", "_", c) for c in df.columns])


def matching_columns(
    columns: Iterable[str],
    prefix: Names = (),
    suffix: Names = (),
    contains: Names = (),
) -> list[str]:
    """PRJ8: names that meet any of the given patterns, in their own order."""
    pre, suf, inner = tuple(names(prefix)), tuple(names(suffix)), names(contains)
    return [c for c in columns
            if c.startswith(pre) or c.endswith(suf) or any(part in c for part in inner)]


def keep_matching(df: DataFrame, always: Names = (ORDER,), **patterns: Names) -> DataFrame:
    kept = names(always) + [c for c in matching_columns(df.columns, **patterns) if c not in names(always)]
    return df.select(*[q(c) for c in kept])


def drop_matching(df: DataFrame, **patterns: Names) -> DataFrame:
    gone = set(matching_columns(df.columns, **patterns))
    return df.select(*[q(c) for c in df.columns if c not in gone])


def exogenous_columns(
    columns: Iterable[str],
    target: str,
    indicators: Iterable[str] = (),
    fixed: Iterable[str] = (KEY, ORDER, *TARGETS),
) -> list[str]:
    """PRJ9: all columns but keys, targets and the forecast column; pass
    `indicators` to take out every indicator and not only the forecast one."""
    out = {target, *indicators, *fixed}
    return [c for c in columns if c not in out]


def require_columns(df: DataFrame, required: Iterable[str], keep: Names = ()) -> DataFrame:
    """PRJ10: `keep` first, then the required columns in order, absent ones as 0.0."""
    have = set(df.columns)
    return df.select(
        *[q(c) for c in names(keep)],
        *[q(c) if c in have else F.lit(0.0).alias(c) for c in required],
    )


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """PRJ11: one row per column that only one of the frames has."""
    a, b = set(left.columns), set(right.columns)
    rows = [(c, "left") for c in sorted(a - b)] + [(c, "right") for c in sorted(b - a)]
    return left.sparkSession.createDataFrame(rows, "column string, only_in string")


def constant_column(df: DataFrame, name: str, value: object) -> DataFrame:
    """PRJ12."""
    return df.withColumn(name, F.lit(value))


def ordinal(c: Column, labels: Iterable[str]) -> Column:
    """PRJ13: position (from 1) of a label in an ordered list, null if absent."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), c)
    return F.when(position > 0, position)


def quarter_number(c: Column) -> Column:
    return ordinal(c, QUARTERS)


def month_number(c: Column) -> Column:
    return ordinal(c, MONTHS)


# --- filters -----------------------------------------------------------------

def split_at(df: DataFrame, date: str = SPLIT_DATE, order: str = ORDER) -> tuple[DataFrame, DataFrame]:
    """FLT1: rows before the date and rows from it on. A range on the raw column,
    so that row groups and partitions prune."""
    edge = F.lit(date).cast(df.schema[order].dataType)
    return df.filter(q(order) < edge), df.filter(q(order) >= edge)


def split_tail(
    df: DataFrame, fraction: float, key: Names = KEY, order: str = ORDER
) -> DataFrame:
    """FLT2: mark the last floor(n * fraction) rows of every series as test."""
    by_key = Window.partitionBy(*[q(c) for c in names(key)])
    position = F.row_number().over(ordered(key, order))
    total = F.count(F.lit(1)).over(by_key)
    return df.withColumn("is_test", position > total - F.floor(total * F.lit(fraction)))


def complete_rows(df: DataFrame, cols: Names | None = None) -> DataFrame:
    """FLT3: rows without a null in the given columns (all when none are given)."""
    return df.na.drop(subset=names(cols) if cols is not None else None)


def varying_columns(train: DataFrame, cols: Iterable[str]) -> list[str]:
    """FLT4, wide form: columns with more than one value in the train frame. Min and
    max tell that from one combinable pass; only one row reaches the driver."""
    cols = list(cols)
    row = train.agg(*[(F.min(q(c)) < F.max(q(c))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def varying_series(
    df: DataFrame, train: DataFrame, key: Names = KEY, value: str = VALUE
) -> DataFrame:
    """FLT4, long form: keep series that vary over the train rows."""
    moving = (train.groupBy(*[q(c) for c in names(key)])
              .agg(F.min(q(value)).alias("_lo"), F.max(q(value)).alias("_hi"))
              .filter("_lo < _hi").select(*[q(c) for c in names(key)]))
    return df.join(moving, names(key), "left_semi")


def dense_columns(df: DataFrame, cols: Iterable[str], minimum: float = 0.7) -> list[str]:
    """FLT5, wide form: columns with at least this share of finite values."""
    cols = list(cols)
    row = df.agg(*[F.avg(finite(q(c)).isNotNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] >= minimum]


def dense_series(
    df: DataFrame, key: Names = KEY, value: str = VALUE, max_missing: float = 0.5
) -> DataFrame:
    """FLT5, long form: drop series with more than this share of missing values."""
    share = (df.groupBy(*[q(c) for c in names(key)])
             .agg(F.avg(finite(q(value)).isNull().cast("int")).alias("_missing"))
             .filter(F.col("_missing") <= max_missing).drop("_missing"))
    return df.join(share, names(key), "left_semi")


def minimum_history(
    df: DataFrame, n: int, key: Names = KEY, value: str = VALUE
) -> DataFrame:
    """FLT6: series with at least n non-null values."""
    enough = (df.groupBy(*[q(c) for c in names(key)]).agg(F.count(q(value)).alias("_n"))
              .filter(F.col("_n") >= n).drop("_n"))
    return df.join(enough, names(key), "left_semi")


def last_points(df: DataFrame, n: int, key: Names = KEY, order: str = ORDER) -> DataFrame:
    """FLT7 / TOP3: the last n rows of every series. A rank filter lets Spark
    stop each partition's window early (WindowGroupLimit)."""
    w = Window.partitionBy(*[q(c) for c in names(key)]).orderBy(q(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_months(
    df: DataFrame, months: int, fallback: int, now: str | None = None,
    key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """FLT7: rows after (now - months); a series with none gives its last `fallback`
    rows. Without `now` the latest date is taken, one scalar from a combinable pass."""
    today = F.lit(now).cast("date") if now else F.lit(df.agg(F.max(q(order))).first()[0])
    w = Window.partitionBy(*[q(c) for c in names(key)])
    flagged = (df.withColumn("_in", q(order) > F.add_months(today, -months))
               .withColumn("_any", F.max("_in").over(w))
               .withColumn("_rn", F.row_number().over(w.orderBy(q(order).desc()))))
    return (flagged.filter(F.col("_in") | (~F.col("_any") & (F.col("_rn") <= fallback)))
            .drop("_in", "_any", "_rn"))


def date_range(df: DataFrame, start: str, end: str, order: str = ORDER) -> DataFrame:
    """FLT8: closed range."""
    kind = df.schema[order].dataType
    return df.filter(q(order).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def outside(c: Column, lower: Column | float, upper: Column | float) -> Column:
    """FLT9: not (lower <= c <= upper); a missing value counts as outside."""
    lower = lower if isinstance(lower, Column) else F.lit(lower)
    upper = upper if isinstance(upper, Column) else F.lit(upper)
    return F.coalesce(~finite(c).between(lower, upper), F.lit(True))


def rename_all(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


