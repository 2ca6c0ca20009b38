"""Seasonal decomposition and anomaly flags (TSO1-TSO7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, back_from_end, finite, names, ordered, q, spread, spread_rows, upto
from macrospark.constants import SEASON
from macrospark.functions.scalar import log_positive
from macrospark.operators.clean import outside
from macrospark.operators.windows import fill_both

PARTS = ["trend", "seasonal", "residual"]


def decompose(
    df: DataFrame, period: int = SEASON, key: Names = KEY, order: str = ORDER, value: str = VALUE,
    minimum: int | None = None,
) -> DataFrame:
    """TSO1: additive decomposition with window functions only. Trend is the centred
    2 x period moving average, its first and last half period carrying the nearest
    value; the seasonal part is the mean detrended value per position, centred; the
    residual is the rest. Series shorter than `minimum` (two periods) get nulls.

    All windows are partitioned by the key (or key and slot), so there is one shuffle."""
    return _decompose(spread(df, names(key)), period, key, order, value, minimum)


def _decompose(
    df: DataFrame, period: int, key: Names, order: str, value: str, minimum: int | None = None,
) -> DataFrame:
    """The same for rows that are dealt by the key already."""
    keys = names(key)
    half, need = period // 2, 2 * period if minimum is None else minimum
    w = ordered(key, order)
    whole = Window.partitionBy(*[q(c) for c in keys])
    v = q(value)
    frame = w.rowsBetween(-half, half)
    raw = (2.0 * F.sum(v).over(frame) - F.lag(v, half).over(w) - F.lead(v, half).over(w)) / (2.0 * period)
    step = df.select("*", (F.row_number().over(w) - 1).alias("_t"), F.count(v).over(whole).alias("_n"),
                     F.when(F.count(v).over(frame) == 2 * half + 1, raw).alias("_ma"))
    step = step.select(
        "*", (F.col("_t") % period).alias("_slot"),
        F.coalesce("_ma", F.last("_ma", True).over(back_from_end(keys, order)), F.last("_ma", True).over(upto(w))).alias("_trend"))
    slot = Window.partitionBy(*[q(c) for c in keys], F.col("_slot"))
    step = step.withColumn("_mean", F.avg(v - F.col("_ma")).over(slot))
    # The first `period` rows hold each slot once.
    step = step.withColumn("_centre", F.avg(F.when(F.col("_t") < period, F.col("_mean"))).over(whole))
    ok = F.col("_n") >= need
    seasonal = F.col("_mean") - F.col("_centre")
    return step.select(
        *[q(c) for c in df.columns],
        F.when(ok, F.col("_trend")).alias("trend"), F.when(ok, seasonal).alias("seasonal"),
        F.when(ok, v - F.col("_trend") - seasonal).alias("residual"))


# --- LOESS (TSO2) -------------------------------------------------------------

#: Longer series are smoothed by the rows of their windows, shorter ones by one dense matrix; the result is the same.
DENSE = 512
#: Rows of all series that are decomposed at a time, about; robust fits hold a window for each.
TOGETHER = 1 << 14


def _loess_windows(n: int, span: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of positions in 0..n-1 around the positions `at`, and their tricube weights."""
    take = min(span, n)
    left = np.clip(np.round(at).astype(int) - take // 2, 0, n - take)
    idx = left[:, None] + np.arange(take)[None, :]
    gap = np.abs(idx - at[:, None])
    reach = np.maximum(at - left, left + take - 1 - at)
    if span > n:
        reach = reach + (span - n) // 2
    reach = np.maximum(reach, 1e-12)[:, None]
    weight = np.where(gap <= 0.999 * reach, (1 - (gap / reach) ** 3) ** 3, 0.0)
    return idx, np.where(gap <= 0.001 * reach, 1.0, weight)


def _loess_fits(
    n: int, idx: np.ndarray, weight: np.ndarray, at: np.ndarray, robust: np.ndarray | None, flat: float | None = None
) -> np.ndarray:
    """Weights on windows that give local linear fits at the positions `at`. A window whose weighted spread is not above `flat`
    (a thousandth of the series' length unless given) is fitted by its mean. `robust` may hold many series as rows; so does the result then."""
    if robust is not None:
        weight = weight * np.take(robust, idx, axis=-1)
    total = weight.sum(axis=-1, keepdims=True)
    weight = np.where(total > 0, weight / np.where(total > 0, total, 1.0), 1.0 / idx.shape[1])
    centre = (weight * idx).sum(axis=-1, keepdims=True)
    spread = (weight * (idx - centre) ** 2).sum(axis=-1)
    steep = np.sqrt(spread) > (0.001 * max(n - 1, 1) if flat is None else flat)
    tilt = np.where(steep, (at - centre[..., 0]) / np.where(spread > 0, spread, 1.0), 0.0)
    return weight * (1 + tilt[..., None] * (idx - centre))


def _dense(n: int, idx: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights on windows as matrices that turn values at 0..n-1 into the fits."""
    matrix = np.zeros((*weight.shape[:-1], n))
    np.put_along_axis(matrix, np.broadcast_to(idx, weight.shape), weight, axis=-1)
    return matrix


def _smooth(
    y: np.ndarray, span: int, beyond: int, robust: np.ndarray | None, cache: dict, flat: float | None = None
) -> np.ndarray:
    """Fits at 0..n-1 and `beyond` positions outside each end. Windows, and weights without robustness,
    depend on lengths only and are kept in `cache`. `y` and `robust` may hold many series as rows."""
    n = y.shape[-1]
    at = np.arange(-float(beyond), n + beyond)
    if (n, span, beyond) not in cache:
        idx, weight = _loess_windows(n, span, at)
        fits = _loess_fits(n, idx, weight, at, None, flat)
        cache[n, span, beyond] = idx, weight, _dense(n, idx, fits) if n <= DENSE else fits
    idx, weight, found = cache[n, span, beyond]
    if robust is not None:
        found = _loess_fits(n, idx, weight, at, robust, flat)
        if n <= DENSE:
            found = _dense(n, idx, found)
    if n > DENSE:
        return (np.take(y, idx, axis=-1) * found).sum(axis=-1)
    # One product per series: its rounding does not depend on the others beside it.
    return (y[..., None, :] @ np.swapaxes(found, -1, -2))[..., 0, :]


def _moving(y: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([np.zeros((*y.shape[:-1], 1)), np.cumsum(y, axis=-1)], axis=-1)
    return (total[..., size:] - total[..., :-size]) / size


def stl_spans(period: int, seasonal: int) -> tuple[int, int]:
    """Spans of the trend and of the low-pass filter."""
    return int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1, (period + 1) | 1


def stl_rounds(
    y: np.ndarray, trend: np.ndarray, care: np.ndarray | None, rounds: int, period: int, seasonal: int,
    cache: dict, flat: float | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend after some inner rounds from a given trend and robustness weights."""
    n, season = y.shape[-1], np.zeros(y.shape)
    trend_span, low_span = stl_spans(period, seasonal)
    for _ in range(rounds):
        detrended = y - trend
        cycle = np.empty((*y.shape[:-1], n + 2 * period))
        for s in range(period):
            cycle[..., s::period] = _smooth(
                detrended[..., s::period], seasonal, 1, None if care is None else care[..., s::period], cache, flat)
        low = _moving(_moving(_moving(cycle, period), period), 3)
        season = cycle[..., period:period + n] - _smooth(low, low_span, 0, None, cache, flat)
        trend = _smooth(y - season, trend_span, 0, care, cache, flat)
    return season, trend


def bisquare(miss: np.ndarray, middle: float | np.ndarray) -> np.ndarray:
    """Robustness weights of absolute residuals with a given median, one for each series where `miss` holds many as rows."""
    edge = 6 * np.asarray(middle)[..., None]
    ratio = np.where(edge > 0, miss / np.where(edge > 0, edge, 1.0), 0.0)
    return np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - ratio ** 2) ** 2, 0.0))


#: Inner rounds without robustness, with it, and the rounds of new weights. Fixed values of the published procedure.
INNER, INNER_ROBUST, OUTER = 5, 2, 15


def stl_arrays(
    y: np.ndarray, period: int = SEASON, seasonal: int = 13, robust: bool = False, cache: dict | None = None,
    outer: int = OUTER, flat: float | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend by the published STL procedure (Cleveland et al., 1990),
    locally linear at every step. `y` may hold many series of one length as rows."""
    cache = {} if cache is None else cache
    season, trend = stl_rounds(y, np.zeros(y.shape), None, INNER_ROBUST if robust else INNER, period, seasonal, cache, flat)
    for _ in range(outer if robust else 0):
        miss = np.abs(y - season - trend)
        season, trend = stl_rounds(y, trend, bisquare(miss, np.median(miss, axis=-1)), INNER_ROBUST, period, seasonal, cache, flat)
    return season, trend


def decompose_loess(
    df: DataFrame, period: int = SEASON, seasonal: int = 13, robust: bool = False,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """TSO2: LOESS decomposition. Each period-grained series, as long as the calendar, is
    packed into one row of arrays; Arrow batches of many series are decomposed
    together by length, TOGETHER rows at a time, and taken apart again in the JVM."""
    keys = names(key)
    by = [q(c) for c in keys]
    points = F.array_sort(F.collect_list(F.struct(q(order), q(value).cast("double").alias("_v"))))
    packed = df.groupBy(*by).agg(points.alias("_p"))
    packed = spread_rows(packed.select(*by, F.col(f"_p.{order}").alias("_at"), F.col("_p._v").alias("_y")), keys)
    parts = ["trend", "seasonal", "residual"]

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in frames:
            filled = [pd.Series(v, dtype=float).ffill().bfill().to_numpy() for v in pdf["_y"]]
            made: dict[str, list] = {p: [np.full(len(y), np.nan) for y in filled] for p in parts}
            groups: dict[int, list[int]] = {}
            for i, y in enumerate(filled):
                if len(y) >= 2 * period and not np.isnan(y).any():
                    groups.setdefault(len(y), []).append(i)
            for rows in (some[a:a + step] for n, some in groups.items() for step in [max(1, TOGETHER // n)] for a in range(0, len(some), step)):
                block = np.stack([filled[i] for i in rows])
                season, trend = stl_arrays(block, period, seasonal, robust, cache)
                for at, i in enumerate(rows):
                    made["trend"][i], made["seasonal"][i] = trend[at], season[at]
                    made["residual"][i] = block[at] - trend[at] - season[at]
            yield pdf.assign(_y=filled, **made)

    kinds = dict(packed.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, "_at"]], "_y array<double>", *[f"{p} array<double>" for p in parts]])
    done = packed.mapInPandas(batch, schema)
    rows = done.select(*by, F.inline(F.arrays_zip("_at", "_y", *parts)))
    return rows.select(*by, F.col("_at").alias(order), F.col("_y").alias(value), *[finite(F.col(p)).alias(p) for p in parts])


# --- train parameters on test rows --------------------------------------------

def decomposition_params(
    parts: DataFrame, period: int = SEASON, key: Names = KEY, order: str = ORDER
) -> DataFrame:
    """One row per series: last trend, the last `period` seasonal values in order, and
    mean and sample std of the residual. This is the table SNK4 stores."""
    keys = names(key)
    w = Window.partitionBy(*[q(c) for c in keys]).orderBy(q(order).desc())
    marked = parts.filter(F.col("trend").isNotNull()).withColumn("_rn", F.row_number().over(w))
    tail = F.when(F.col("_rn") <= period, F.struct(q(order), F.col("seasonal")))
    return marked.groupBy(*[q(c) for c in keys]).agg(
        F.max_by("trend", q(order)).alias("last_trend"),
        F.transform(F.array_sort(F.collect_list(tail)), lambda s: s["seasonal"]).alias("pattern"),
        F.avg("residual").alias("residual_mean"), F.stddev_samp("residual").alias("residual_std"),
        F.count("residual").alias("residual_count"))


def apply_decomposition(
    test: DataFrame, params: DataFrame, period: int = SEASON, key: Names = KEY, order: str = ORDER,
    value: str = VALUE,
) -> DataFrame:
    """TSO3: frozen last trend, tiled seasonal pattern, residual against both."""
    placed = fill_both(test, key, order, value, "_filled").withColumn(
        "_slot", (F.row_number().over(ordered(key, order)) - 1) % period)
    seasonal = F.get("pattern", F.col("_slot"))
    return (placed.join(params.select(*[q(c) for c in names(key)], "last_trend", "pattern"), names(key), "left")
            .select(*[q(c) for c in test.columns], F.col("last_trend").alias("trend"), seasonal.alias("seasonal"),
                    (F.col("_filled") - (F.col("last_trend") + seasonal)).alias("residual")))


def decompose_split(
    df: DataFrame, split: str, period: int = SEASON, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """TSO1 before the split and TSO3 after it in one pass. Each side is a partition of
    its own; what the test side needs of the train side (last trend, last seasonal
    values) comes from windows over the whole series. The rows are shuffled once, by
    series, instead of once per branch. Adds `is_train` and the three parts."""
    keys = names(key)
    side = [*keys, "is_train"]
    train = F.col("is_train")
    rows = spread(df, keys).withColumn("is_train", q(order) < F.lit(split).cast(df.schema[order].dataType))
    parts = _decompose(fill_both(rows, side, order, value, "_filled"), period, side, order, "_filled")
    reverse = Window.partitionBy(*[q(c) for c in side]).orderBy(q(order).desc())
    parts = parts.select("*", ((F.row_number().over(ordered(side, order)) - 1) % period).alias("_slot"),
                         F.row_number().over(reverse).alias("_back"))
    whole = Window.partitionBy(*[q(c) for c in keys])
    known = train & F.col("trend").isNotNull()
    last = F.max(F.when(known, F.struct(q(order), F.col("trend")))).over(whole)["trend"]
    pattern = F.array_sort(F.collect_list(
        F.when(known & (F.col("_back") <= period), F.struct(q(order), F.col("seasonal")))).over(whole))
    parts = parts.select("*", last.alias("_last"), pattern.alias("_pattern"))
    seasonal = F.get("_pattern", F.col("_slot"))["seasonal"]
    return parts.select(
        *[q(c) for c in df.columns if c != value], F.when(train, F.col("_filled")).otherwise(q(value)).alias(value), "is_train",
        F.when(train, F.col("trend")).otherwise(F.col("_last")).alias("trend"),
        F.when(train, F.col("seasonal")).otherwise(seasonal).alias("seasonal"),
        F.when(train, F.col("residual")).otherwise(F.col("_filled") - (F.col("_last") + seasonal)).alias("residual"))


def flag_split(
    parts: DataFrame, sigmas: float = 3.0, minimum: int = 10, key: Names = KEY, output: str = "anomaly"
) -> DataFrame:
    """TSO6 on the rows of `decompose_split`, without leaving their partitions."""
    whole = Window.partitionBy(*[q(c) for c in names(key)])
    fit = F.when(F.col("is_train"), F.col("residual"))
    marked = parts.select("*", F.avg(fit).over(whole).alias("_m"), F.stddev_samp(fit).over(whole).alias("_s"),
                          F.count(fit).over(whole).alias("_n"))
    std = F.when(F.col("_s") == 0, F.lit(1e-6)).otherwise(F.col("_s"))
    hit = F.coalesce(F.abs(F.col("residual") - F.col("_m")) > sigmas * std, F.lit(False))
    return marked.withColumn(output, F.when(F.col("_n") >= minimum, hit.cast("int"))).drop("_m", "_s", "_n")


def decompose_multiplicative(
    df: DataFrame, period: int = SEASON, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """TSO4: decompose the log, transform back, and give the seasonally adjusted value."""
    logged = fill_both(spread(df, names(key)).withColumn("_log", log_positive(F.when(q(value) > 0, q(value)))), key, order, "_log")
    parts = _decompose(logged, period, key, order, "_log").drop("_log")
    return parts.withColumns({p: F.exp(p) for p in PARTS}).withColumn(
        "adjusted", F.try_divide(q(value), F.col("seasonal")))


def seasonally_adjusted(parts: DataFrame, value: str = VALUE) -> DataFrame:
    """TSO4, additive."""
    return parts.withColumn("adjusted", q(value) - F.col("seasonal"))


def decompose_forecast(
    history: DataFrame, forecast: DataFrame, period: int = SEASON, key: Names = KEY, order: str = ORDER,
    value: str = VALUE,
) -> DataFrame:
    """TSO5: decompose history and forecast as one series and keep the forecast part.
    Series with under two periods of values get the forecast mean as trend."""
    keys = names(key)
    cols = [*keys, order, value]
    both = (fill_both(spread(history.select(*[q(c) for c in cols]), keys), key, order, value).withColumn("_future", F.lit(False))
            .unionByName(forecast.select(*[q(c) for c in cols]).withColumn("_future", F.lit(True))))
    parts = decompose(both, period, key, order, value).filter("_future")
    mean = F.avg(q(value)).over(Window.partitionBy(*[q(c) for c in keys]))
    short = F.col("trend").isNull()
    return parts.select(
        *[q(c) for c in cols], F.when(short, mean).otherwise(F.col("trend")).alias("trend"),
        F.when(short, q(value) - mean).otherwise(F.col("residual")).alias("residual"))


# --- anomalies ----------------------------------------------------------------

def anomaly_bounds(
    train: DataFrame, column: str = "residual", sigmas: float = 3.0, minimum: int = 10, key: Names = KEY
) -> DataFrame:
    """TSO6: mean +- 3 sample std of the train residuals (std 0 becomes 1e-6)."""
    stats = train.groupBy(*[q(c) for c in names(key)]).agg(
        F.avg(q(column)).alias("mean"), F.stddev_samp(q(column)).alias("_std"), F.count(q(column)).alias("_n"))
    std = F.when(F.col("_std") == 0, F.lit(1e-6)).otherwise(F.col("_std"))
    return (stats.filter(F.col("_n") >= minimum).withColumn("std", std)
            .select(*[q(c) for c in names(key)], "mean", "std",
                    (F.col("mean") - sigmas * F.col("std")).alias("lower_bound"),
                    (F.col("mean") + sigmas * F.col("std")).alias("upper_bound")))


def flag_residuals(
    df: DataFrame, bounds: DataFrame, column: str = "residual", key: Names = KEY, output: str = "anomaly"
) -> DataFrame:
    """TSO6: 1 where the residual leaves the bounds; a missing residual is not flagged."""
    edges = bounds.select(*[q(c) for c in names(key)], "lower_bound", "upper_bound")
    hit = (q(column) < F.col("lower_bound")) | (q(column) > F.col("upper_bound"))
    return (df.join(edges, names(key), "left")
            .withColumn(output, F.when(F.col("lower_bound").isNotNull(), F.coalesce(hit, F.lit(False)).cast("int")))
            .drop("lower_bound", "upper_bound"))


def flag_values(
    df: DataFrame, bounds: DataFrame, key: Names = KEY, value: str = VALUE, output: str = "anomaly"
) -> DataFrame:
    """TSO7: 1 where a value is outside given bounds; a missing value is flagged."""
    edges = bounds.select(*[q(c) for c in names(key)], "lower_bound", "upper_bound")
    return (df.join(edges, names(key), "left")
            .withColumn(output, outside(q(value), F.col("lower_bound"), F.col("upper_bound")).cast("int"))
            .drop("lower_bound", "upper_bound"))


