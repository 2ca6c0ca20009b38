"""Window operators over period-grained series (WIN1-WIN23).

Every function takes a long frame (one row per key and period) and adds columns.
All columns of one call come from one select over one window, so a call costs one
shuffle and one sort whatever the number of columns; calls on the same key share
that shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from macrospark.columns import (
    KEY, ORDER, VALUE, Names, back_from_end, finite, names, ordered, q, spread, upto,
)

STATS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def rolling(
    c: Column, w: WindowSpec, size: int, stat: str, offset: int = 0, min_periods: int | None = None
) -> Column:
    """One rolling statistic over `size` rows that end `offset` rows back; null
    unless `min_periods` (all rows by default) of them hold a value."""
    frame = w.rowsBetween(-(size - 1) - offset, -offset)
    need = size if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, STATS[stat](c).over(frame))


def horizon_targets(
    df: DataFrame, horizons: Iterable[int] = (1, 3, 6), key: Names = KEY,
    order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN1: the value k rows ahead, for each horizon."""
    w = ordered(key, order)
    return df.select("*", *[F.lead(q(value), k).over(w).alias(f"{value}_lead{k}") for k in horizons])


def lags(
    df: DataFrame, ks: Iterable[int] = (1, 3, 6), key: Names = KEY,
    order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN2."""
    w = ordered(key, order)
    return df.select("*", *[F.lag(q(value), k).over(w).alias(f"{value}_lag{k}") for k in ks])


def rolling_previous(
    df: DataFrame, sizes: Iterable[int] = (3, 6, 12), stats: Iterable[str] = ("mean", "std", "max", "min"),
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN3: leak-free rolling statistics over the previous rows only."""
    w = ordered(key, order)
    return df.select("*", *[
        rolling(q(value), w, n, s, offset=1).alias(f"{value}_roll{s}{n}") for n in sizes for s in stats])


def rolling_current(
    df: DataFrame, sizes: Iterable[int] = (12,), stats: Iterable[str] = ("mean", "std"),
    min_periods: int | None = 1, key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN4 (with `min_periods`) and WIN5 (strict, `min_periods=None`)."""
    w = ordered(key, order)
    return df.select("*", *[
        rolling(q(value), w, n, s, min_periods=min_periods).alias(f"{value}_{s}{n}")
        for n in sizes for s in stats])


def moving_averages(
    df: DataFrame, sizes: Iterable[int] = (1, 3, 6), key: Names = KEY,
    order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN6: strict simple moving averages."""
    w = ordered(key, order)
    return df.select("*", *[rolling(q(value), w, n, "mean").alias(f"{value}_sma{n}") for n in sizes])


def trend_gaps(df: DataFrame, value: str = VALUE) -> DataFrame:
    """WIN8: differences of the averages made by `moving_averages`."""
    pairs = [(1, 3), (1, 6), (3, 6)]
    return df.select("*", *[
        (q(f"{value}_sma{a}") - q(f"{value}_sma{b}")).alias(f"{value}_gap{a}_{b}") for a, b in pairs])


def differences(
    df: DataFrame, ks: Iterable[int] = (1, 3), second: bool = True, key: Names = KEY,
    order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN9: v - lag_k(v), and the difference of the first difference."""
    w = ordered(key, order)
    cols = [(q(value) - F.lag(q(value), k).over(w)).alias(f"{value}_diff{k}") for k in ks]
    if second:
        cols.append((q(value) - 2 * F.lag(q(value), 1).over(w) + F.lag(q(value), 2).over(w))
                    .alias(f"{value}_second_diff"))
    return df.select("*", *cols)


def percent_change(
    df: DataFrame, k: int = 1, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN10: change against k rows back after padding nulls forward. A zero base
    gives null (never an infinity)."""
    w = ordered(key, order)
    padded = df.withColumn("_pad", F.last(q(value), ignorenulls=True).over(upto(w)))
    return padded.withColumn(
        f"{value}_pct_change{k}", F.try_divide(F.col("_pad"), F.lag("_pad", k).over(w)) - 1).drop("_pad")


def forward_fill(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE, output: str | None = None
) -> DataFrame:
    """WIN11. Pass a finer key, such as (series, year), for WIN13."""
    w = upto(ordered(key, order))
    return df.withColumn(output or value, F.last(q(value), ignorenulls=True).over(w))


def backward_fill(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE, output: str | None = None
) -> DataFrame:
    """WIN12."""
    return df.withColumn(output or value, F.last(q(value), ignorenulls=True).over(back_from_end(key, order)))


def fill_both(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE, output: str | None = None
) -> DataFrame:
    """Forward fill, then backward fill what is left at the head."""
    w = ordered(key, order)
    return df.withColumn(output or value, F.coalesce(
        F.last(q(value), ignorenulls=True).over(upto(w)),
        F.last(q(value), ignorenulls=True).over(back_from_end(key, order))))


def fill_within_year(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN13: fill both ways, never across a year boundary."""
    return fill_both(df.withColumn("_year", F.year(q(order))), [*names(key), "_year"],
                     order, value).drop("_year")


def interpolate(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE, output: str | None = None
) -> DataFrame:
    """Linear interpolation by row position. Leading nulls stay, trailing nulls
    take the last known value."""
    w = ordered(key, order)
    v = q(value)
    placed = df.withColumn("_pos", F.row_number().over(w))
    known = F.when(v.isNotNull(), F.col("_pos"))
    back = back_from_end(key, order)
    marked = placed.select(
        "*",
        F.last(v, True).over(upto(w)).alias("_v0"), F.last(known, True).over(upto(w)).alias("_p0"),
        F.last(v, True).over(back).alias("_v1"), F.last(known, True).over(back).alias("_p1"))
    step = F.try_divide(F.col("_pos") - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    filled = F.coalesce(v, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * step, F.col("_v0"))
    # A row before the first known value has no _v0 and stays null.
    return marked.withColumn(output or value, filled).drop("_pos", "_v0", "_p0", "_v1", "_p1")


def monthly_spine(df: DataFrame, key: Names = KEY, order: str = ORDER) -> DataFrame:
    """Every month between the first and last date of each series."""
    return (df.groupBy(*[q(c) for c in names(key)])
            .agg(F.min(q(order)).alias("_lo"), F.max(q(order)).alias("_hi"))
            .select(*[q(c) for c in names(key)],
                    F.explode(F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"),
                                         F.expr("interval 1 month"))).alias(order)))


def upsample_monthly(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN14: put a sparser series on the monthly calendar and interpolate."""
    on = [*names(key), order]
    rows = spread(monthly_spine(df, key, order), on).join(spread(df, on), on, "left")
    return interpolate(spread(rows, key), key, order, value)


def interpolate_full(
    df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN15: interpolate, then fill what is left at the head and the tail."""
    return fill_both(interpolate(df, key, order, value), key, order, value)


def fill_cascade(
    df: DataFrame, medians: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN16: non-finite to null, forward fill, backward fill, then the median of
    the series from `medians` (key, median; fitted on train), then 0."""
    cleaned = fill_both(df.withColumn(value, finite(q(value))), key, order, value)
    return (cleaned.join(medians, names(key), "left")
            .withColumn(value, F.coalesce(q(value), F.col("median"), F.lit(0.0))).drop("median"))


def undo_differencing(
    df: DataFrame, levels: DataFrame, d: int, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN17: integrate d times. `levels` holds key and level0..level{d-1}: the last
    train value of the series and of each lower-order difference."""
    w = upto(ordered(key, order))
    out = df.join(levels, names(key), "left")
    for i in reversed(range(d)):
        out = out.withColumn(value, F.sum(q(value)).over(w) + F.col(f"level{i}"))
    return out.drop(*[f"level{i}" for i in range(d)])


def last_levels(
    df: DataFrame, d: int, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """Last value of each difference of order 0..d-1, per series."""
    w = ordered(key, order)
    out, current = df, q(value)
    cols = []
    for i in range(d):
        out = out.withColumn(f"_d{i}", current)
        current = F.col(f"_d{i}") - F.lag(f"_d{i}", 1).over(w)
        cols.append(F.max_by(f"_d{i}", q(order)).alias(f"level{i}"))
    return out.groupBy(*[q(c) for c in names(key)]).agg(*cols)


def time_index(df: DataFrame, key: Names = KEY, order: str = ORDER, output: str = "t") -> DataFrame:
    """WIN19: 0, 1, 2, ... in each series."""
    return df.withColumn(output, F.row_number().over(ordered(key, order)) - 1)


def sequences(
    df: DataFrame, steps: int, features: Names = VALUE, key: Names = KEY,
    order: str = ORDER, target: str = VALUE,
) -> DataFrame:
    """WIN20: the last `steps` feature rows as an array of arrays, and the next
    value of the target. The frame is bounded, so memory per row is too."""
    w = ordered(key, order)
    frame = w.rowsBetween(-(steps - 1), 0)
    point = F.array(*[q(c).cast("double") for c in names(features)])
    return (df.select("*", F.collect_list(point).over(frame).alias("x"),
                      F.lead(q(target), 1).over(w).alias("y"))
            .filter((F.size("x") == steps) & F.col("y").isNotNull()))


def residual_features(
    df: DataFrame, residual: str, series: str, exogenous: Iterable[str] = (),
    key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """WIN21: lags and short rolling statistics of residual, series and exogenous columns."""
    w = ordered(key, order)
    r, s = q(residual), q(series)
    cols = [F.lag(r, k).over(w).alias(f"residual_lag_{k}") for k in range(1, 6)]
    for n in (3, 5):
        cols += [rolling(r, w, n, "mean", min_periods=1).alias(f"residual_ma_{n}"),
                 rolling(r, w, n, "std", min_periods=1).alias(f"residual_std_{n}")]
    cols += [F.lag(s, k).over(w).alias(f"series_lag_{k}") for k in range(1, 4)]
    for n in (3, 5, 10):
        cols += [rolling(s, w, n, "mean", min_periods=1).alias(f"series_ma_{n}"),
                 rolling(s, w, n, "std", min_periods=1).alias(f"series_std_{n}")]
    cols += [F.lag(q(c), k).over(w).alias(f"{c}_lag_{k}") for c in exogenous for k in (1, 2)]
    return df.select("*", *cols)


def changing_variance(
    df: DataFrame, size: int = 12, min_periods: int = 6, threshold: float = 0.5,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """WIN22: r2 of rolling std on rolling mean, and whether it passes the threshold
    with more than five points."""
    w = ordered(key, order)
    m = rolling(q(value), w, size, "mean", min_periods=min_periods)
    s = rolling(q(value), w, size, "std", min_periods=min_periods)
    return (df.select(*[q(c) for c in names(key)], m.alias("_m"), s.alias("_s"))
            .filter("_m is not null and _s is not null")
            .groupBy(*[q(c) for c in names(key)])
            .agg(F.count(F.lit(1)).alias("points"), F.regr_r2("_s", "_m").alias("r2"))
            .withColumn("changing", (F.col("points") > 5) & F.coalesce(F.col("r2") > threshold, F.lit(False))))


def tile_pattern(
    df: DataFrame, pattern: DataFrame, period: int = 12, key: Names = KEY, order: str = ORDER
) -> DataFrame:
    """WIN23: repeat a seasonal pattern (key, slot 0..period-1, seasonal) over rows."""
    placed = df.withColumn("slot", (F.row_number().over(ordered(key, order)) - 1) % period)
    return placed.join(pattern, [*names(key), "slot"], "left").drop("slot")


def last_pattern(
    df: DataFrame, value: str, period: int = 12, key: Names = KEY, order: str = ORDER
) -> DataFrame:
    """The last `period` values of each series as slots 0..period-1."""
    w = Window.partitionBy(*[q(c) for c in names(key)]).orderBy(q(order).desc())
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= period)
            .select(*[q(c) for c in names(key)], (F.lit(period) - F.col("_rn")).alias("slot"),
                    q(value).alias("seasonal")))


# --- autocorrelation ----------------------------------------------------------

def acf_features(
    df: DataFrame, nlags: int = 10, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """AGG18: one row per series with the biased ACF of the series and its first
    two differences: lag 1 and the sum of squares of lags 1..nlags. The seasonal
    entry is lag min(12, nlags). Series with under nlags + 5 values are left out;
    differences with under nlags + 2 values give 0."""
    keys = names(key)
    w = ordered(key, order)
    whole = Window.partitionBy(*[q(c) for c in keys])
    forms = {"original": q(value),
             "diff1": q(value) - F.lag(q(value), 1).over(w),
             "diff2": q(value) - 2 * F.lag(q(value), 1).over(w) + F.lag(q(value), 2).over(w)}
    filled = fill_both(df, key, order, value).filter(q(value).isNotNull())
    staged = filled.select(*[q(c) for c in keys], q(order), *[c.alias(f) for f, c in forms.items()])
    centred = staged.select(*[q(c) for c in keys], q(order),
                            *[(F.col(f) - F.avg(f).over(whole)).alias(f) for f in forms])
    lagged = centred.select("*", *[
        (F.col(f) * F.lag(f, k).over(w)).alias(f"_{f}_{k}") for f in forms for k in range(1, nlags + 1)])
    sums = lagged.groupBy(*[q(c) for c in keys]).agg(
        *[F.count(f).alias(f"_n_{f}") for f in forms],
        *[F.sum(F.col(f) * F.col(f)).alias(f"_g_{f}") for f in forms],
        *[F.sum(f"_{f}_{k}").alias(f"_{f}_{k}") for f in forms for k in range(1, nlags + 1)])

    def ratio(f: str, k: int) -> Column:
        return F.try_divide(F.col(f"_{f}_{k}"), F.col(f"_g_{f}"))

    out = []
    for f in forms:
        first = ratio(f, 1)
        squares = sum((ratio(f, k) * ratio(f, k) for k in range(2, nlags + 1)), first * first)
        if f != "original":
            long_enough = F.col(f"_n_{f}") >= nlags + 2
            first = F.when(long_enough, first).otherwise(0.0)
            squares = F.when(long_enough, squares).otherwise(0.0)
        out += [first.alias(f"first_acf_{f}"), squares.alias(f"sumsq_acf_{f}")]
    out.append(ratio("original", min(12, nlags)).alias("seasonal_acf"))
    return (sums.filter(F.col("_n_original") >= nlags + 5)
            .select(*[q(c) for c in keys], *out))


def expanding_acf(
    df: DataFrame, nlags: int = 10, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """WIN18: ACF features of the history up to each row, from running sums. One
    pass instead of one autocorrelation per row; null until history is long enough."""
    keys = names(key)
    w = ordered(key, order)
    z = df.filter(q(value).isNotNull()).withColumn(
        "_original", q(value) - F.first(q(value)).over(upto(w)))
    # Differences of the shifted series equal those of the series itself.
    z = z.select("*", (F.col("_original") - F.lag("_original", 1).over(w)).alias("_diff1"))
    z = z.select("*", (F.col("_diff1") - F.lag("_diff1", 1).over(w)).alias("_diff2"))
    forms = ["original", "diff1", "diff2"]
    run = upto(w)
    sums = z.select(
        "*",
        *[F.count(f"_{f}").over(run).alias(f"_n_{f}") for f in forms],
        *[F.sum(f"_{f}").over(run).alias(f"_s_{f}") for f in forms],
        *[F.sum(F.col(f"_{f}") * F.col(f"_{f}")).over(run).alias(f"_q_{f}") for f in forms],
        *[(F.col(f"_{f}") * F.lag(f"_{f}", k).over(w)).alias(f"_x_{f}_{k}")
          for f in forms for k in range(1, nlags + 1)])
    # Head sums: the first k values of each form, constant over the series once seen.
    heads = sums.select(
        "*",
        *[F.sum(f"_x_{f}_{k}").over(run).alias(f"_p_{f}_{k}") for f in forms for k in range(1, nlags + 1)],
        *[F.max(F.when(F.col(f"_n_{f}") == k, F.col(f"_s_{f}"))).over(run).alias(f"_h_{f}_{k}")
          for f in forms for k in range(1, nlags + 1)],
        *[F.lag(f"_s_{f}", k).over(w).alias(f"_b_{f}_{k}") for f in forms for k in range(1, nlags + 1)])

    def r(f: str, k: int) -> Column:
        n, s = F.col(f"_n_{f}"), F.col(f"_s_{f}")
        m = s / n
        tail, lead = s - F.col(f"_h_{f}_{k}"), F.col(f"_b_{f}_{k}")
        cov = F.col(f"_p_{f}_{k}") - m * (tail + lead) + (n - k) * m * m
        return F.try_divide(cov, F.col(f"_q_{f}") - n * m * m)

    out = []
    for f in forms:
        ready = F.col(f"_n_{f}") > nlags
        squares = sum((r(f, k) * r(f, k) for k in range(2, nlags + 1)), r(f, 1) * r(f, 1))
        out += [F.when(ready, r(f, 1)).alias(f"acf1_{f}"), F.when(ready, squares).alias(f"sumsq_acf_{f}")]
    return heads.select(*[q(c) for c in keys], q(order), q(value), *out)


