"""Seasonal differencing by test (TSO14): a seasonal unit-root regression for each series decides whether it is differenced over a season, the difference is
forecast by the ordered models, and the way back adds it to the last season known."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, ordered, q, spread_rows
from macrospark.operators.forecast import SEASONAL_ORDER, LagModel, _schema, full_matrices, lag_model_forecast
from macrospark.operators.stationarity import best_lags
from macrospark.operators.windows import fill_both

#: Share of its seasonal lag's squares below which a double difference is taken for rounding.
REPEATS = 1e-12


def seasonal_critical(period: int) -> float:
    """5 % value of the seasonal unit-root statistic: the published smooth curve over the length of the season (its constants are fixed values)."""
    x = math.log(period) - 0.7656451
    return -0.2937411 * math.exp(-0.2850853 * x - 0.05983644 * x * x) - 1.652202


def seasonal_root_test(
    df: DataFrame, period: int = 12, max_lags: int = 3, critical: float | None = None, key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """Per series: n, lags, t_stat and seasonal_d. The change of the seasonal difference is regressed, without intercept, on the seasonal difference one step ago and the change one season ago;
    up to `max_lags` of its own lags are added, as many as have the least AIC. t_stat belongs to the change one season ago; at or above the critical value the seasonal root stands and seasonal_d is 1. So it is
    for a series that repeats its season exactly. A series too short for the test has 0."""
    keys = names(key)
    by, w = [q(c) for c in keys], ordered(keys, order)
    edge = seasonal_critical(period) if critical is None else critical
    unit = F.coalesce(F.nullif(F.avg(F.abs(q(value))).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(1.0))
    rows = fill_both(df, keys, order, value).select(*by, q(order), (q(value).cast("double") / unit).alias("_v"))
    rows = rows.select(*by, q(order), (F.col("_v") - F.lag("_v", 1).over(w)).alias("_d"), (F.col("_v") - F.lag("_v", period).over(w)).alias("_s"))
    rows = rows.select(*by, q(order), F.lag("_s", 1).over(w).alias("_a"), F.lag("_d", period).over(w).alias("_b"), (F.col("_s") - F.lag("_s", 1).over(w)).alias("_w"))
    own = [F.lag("_w", i).over(w) for i in range(1, max_lags + 1)]
    ready = F.lag("_w", max_lags).over(w).isNotNull() if max_lags else F.col("_w").isNotNull()
    rows = rows.select(*by, F.when(ready, F.array("_a", *own, "_b", "_w")).alias("_x"))
    size = max_lags + 3
    x = F.col("_x")
    sums = spread_rows(rows.groupBy(*by).agg(F.count(x).alias("n"), F.array(
        *[F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)) for i in range(size) for j in range(i, size)]).alias("g")), keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            g = full_matrices(np.stack(pdf["g"].to_list()), size)
            lags, t = best_lags(pdf["n"].to_numpy(dtype=float), g)
            repeats = (g[:, -2, -2] > 0) & (g[:, -1, -1] <= REPEATS * g[:, -2, -2])
            yield pdf[[*keys, "n"]].assign(lags=lags, t_stat=np.where(repeats, np.nan, t), seasonal_d=((t >= edge) | repeats).astype(np.int64))

    out = sums.mapInPandas(solve, f"{_schema(sums, keys)}, n bigint, lags bigint, t_stat double, seasonal_d bigint")
    return out.withColumn("t_stat", F.when(~F.isnan("t_stat"), F.col("t_stat")))


def seasonal_difference(df: DataFrame, period: int = 12, key: Names = KEY, order: str = ORDER, value: str = VALUE) -> DataFrame:
    """Each value less the one a season before; the first season of a series has none and is left out."""
    rows = df.withColumn("_ago", F.lag(q(value), period).over(ordered(key, order))).withColumn("_row", F.row_number().over(ordered(key, order)))
    return rows.filter(F.col("_row") > period).withColumn(value, q(value) - F.col("_ago")).drop("_ago", "_row")


def last_season(df: DataFrame, period: int = 12, key: Names = KEY, order: str = ORDER, value: str = VALUE) -> DataFrame:
    """Per series the array `season` of its last values, in time order; shorter where the series is."""
    back = df.select(*[q(c) for c in names(key)], q(order), q(value), F.row_number().over(
        Window.partitionBy(*[q(c) for c in names(key)]).orderBy(q(order).desc())).alias("_back")).filter(F.col("_back") <= period)
    return back.groupBy(*[q(c) for c in names(key)]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_back"), q(value).alias("v")))), lambda r: r["v"]).alias("season"))


def undo_seasonal_difference(ahead: DataFrame, season: DataFrame, period: int = 12, columns: Sequence[str] = ("forecast",), key: Names = KEY) -> DataFrame:
    """The way back. `ahead` has the steps 1, 2 ... after the last value of each series, `columns` being seasonal differences; they become levels, each step standing on the one a season before it. A series
    whose `season` (see `last_season`) is missing or short has null levels at the places it lacks."""
    keys = names(key)
    place = (F.col("step") - 1) % period
    w = Window.partitionBy(*[q(c) for c in keys], place).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = ahead.join(season, keys, "left")
    base = F.when(F.size("season") == period, F.get("season", place.cast("int")))
    return rows.withColumns({c: base + F.sum(q(c)).over(w) for c in columns}).drop("season")


def seasonal_forecast(
    df: DataFrame, steps: int, period: int = 12, models: Sequence[LagModel] = tuple(SEASONAL_ORDER), max_lags: int = 3, critical: float | None = None,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """TSO14 with the seasonal difference chosen by `seasonal_root_test`; the first usable model of the order forecasts the value or its seasonal difference. Rows are (key, date, step, seasonal_d, model, forecast,
    lower, upper). The 95 % interval of a differenced series is exact for the first season; later steps add up the widths of their place in the season, which bounds it from above."""
    keys = names(key)
    by = [q(c) for c in keys]
    filled = fill_both(df.select(*by, q(order), q(value)), keys, order, value)
    test = seasonal_root_test(df, period, max_lags, critical, keys, order, value).select(*by, "seasonal_d")
    w = ordered(keys, order)
    rows = filled.join(test, keys).withColumns({"_ago": F.lag(q(value), period).over(w), "_row": F.row_number().over(w)})
    differenced = F.col("seasonal_d") == 1
    work = rows.filter(~differenced | (F.col("_row") > period)).withColumn(value, F.when(differenced, q(value) - F.col("_ago")).otherwise(q(value)))
    ahead = lag_model_forecast(work.select(*by, q(order), q(value)), steps, models, pick="first", key=keys, order=order, value=value)
    ahead = ahead.join(test, keys).join(last_season(filled, period, keys, order, value), keys)
    place = (F.col("step") - 1) % period
    same = Window.partitionBy(*by, place).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ahead = ahead.withColumns({"_half": (F.col("upper") - F.col("lower")) / 2})
    ahead = ahead.withColumns({
        "forecast": F.when(differenced, F.get("season", place.cast("int")) + F.sum("forecast").over(same)).otherwise(F.col("forecast")),
        "_half": F.when(differenced, F.sum("_half").over(same)).otherwise(F.col("_half"))})
    return ahead.select(*by, q(order), "step", "seasonal_d", "model", "forecast", (F.col("forecast") - F.col("_half")).alias("lower"),
                        (F.col("forecast") + F.col("_half")).alias("upper"))
