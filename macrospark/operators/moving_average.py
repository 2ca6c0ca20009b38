"""Moving-average terms by two rounds of least squares (TSO12): a long autoregression gives each series' residuals, whose lags then stand beside the lags of the
series in a second regression. Both rounds are sums of products folded per series; of the second there is one matrix, of which every order of the grid
is a part."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, ordered, q, spread_rows
from macrospark.operators.forecast import Z95, _schema, difference_columns, full_matrices, gram, information, least_squares, solve_systems
from macrospark.operators.windows import fill_both

#: Lags p up to 3 and residual lags q up to 2.
ARMA_GRID = [(p, k) for p in range(4) for k in range(3)]


def residual_rows(
    df: DataFrame, lags: int, residual_lags: int, d: int = 0, long: int = 6, key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """Rows of the second round: key, order, unit, v (the filled value over its mean size `unit`), y (its d-th difference), e (the residual of an autoregression of `long` lags), y1, y2 ...
    and e1, e2 ... (their lags). A residual is null where a lag is missing, and for a series too short for the long autoregression."""
    keys = names(key)
    by, w = [q(c) for c in keys], ordered(keys, order)
    unit = F.coalesce(F.nullif(F.avg(F.abs(q(value))).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(1.0))
    scaled = fill_both(df, keys, order, value).select(*by, q(order), unit.alias("unit"), (q(value).cast("double") / unit).alias("v"))
    own = difference_columns(scaled, d, keys, order, "v").select(*by, q(order), "unit", "v", F.col(f"_d{d}").alias("y"))
    own = own.select("*", *[F.lag("y", k).over(w).alias(f"y{k}") for k in range(1, max(long, lags) + 1)])
    first = [f"y{k}" for k in range(1, long + 1)]
    fit = least_squares(own, first, "y", keys).select(*by, F.col("coef").alias("_coef"))
    fitted = F.aggregate(F.zip_with("_coef", F.array(F.lit(1.0), *[F.col(c) for c in first]), lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)
    rows = own.join(fit, keys, "left").withColumn("e", F.col("y") - fitted).drop("_coef")
    return rows.select(*by, q(order), "unit", "v", "y", "e", *[f"y{k}" for k in range(1, lags + 1)],
                       *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, residual_lags + 1)])


def moving_average_sums(
    df: DataFrame, lags: int, residual_lags: int, d: int = 0, long: int = 6, key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """The sums of products (see `forecast.gram`) of the second round, over the rows complete in all lags."""
    rows = residual_rows(df, lags, residual_lags, d, long, key, order, value)
    return gram(rows, [*[f"y{k}" for k in range(1, lags + 1)], *[f"e{k}" for k in range(1, residual_lags + 1)]], "y", key)


def moving_average_forecast(
    df: DataFrame, steps: int, grid: Sequence[tuple[int, int]] = tuple(ARMA_GRID), d: int = 0, long: int = 6,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """TSO12 with moving-average terms: per series the (p, q) of the grid with the least AIC over common rows, and its forecasts with 95 % intervals. Rows are (key, date, step, p, q,
    aic, forecast, lower, upper); a series too short for every order gives its last value (p, q and the interval are null)."""
    keys = names(key)
    by = [q(c) for c in keys]
    most_p, most_q = (max(o[i] for o in grid) for i in (0, 1))
    keep = d + max(most_p, most_q, 1)
    rows = residual_rows(df, most_p, most_q, d, long, keys, order, value)
    sums = gram(rows, [*[f"y{k}" for k in range(1, most_p + 1)], *[f"e{k}" for k in range(1, most_q + 1)]], "y", keys)
    back = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(q(order).desc())))
    tail = F.array_sort(F.collect_list(F.when(F.col("_back") <= keep, F.struct(q(order), "v", "e"))))
    tails = back.groupBy(*by).agg(F.max(q(order)).alias("last_date"), F.max("unit").alias("unit"), F.transform(tail, lambda r: r["v"]).alias("levels"),
                                  F.transform(tail, lambda r: r["e"]).alias("residuals"))
    ready = spread_rows(tails.join(sums, keys, "left"), keys)
    size = 1 + most_p + most_q

    def ends(pdf: pd.DataFrame, column: str) -> np.ndarray:
        out = np.full((len(pdf), keep), np.nan)
        for i, v in enumerate(pdf[column]):
            out[i, keep - len(v):] = np.array(v, dtype=float)
        return out

    def path(p: int, k: int, coef: np.ndarray, levels: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forecast levels, and the multipliers of the residual's deviation."""
        differences = [levels]
        for _ in range(d):
            differences.append(np.diff(differences[-1], axis=1))
        past, ahead = list(differences[-1].T), list(residuals.T)
        psi = np.zeros((len(coef), steps))
        for h in range(steps):
            now = coef[:, 0].copy()
            for i in range(1, p + 1):
                now += coef[:, i] * past[-i]
            for j in range(1, k + 1):
                now += coef[:, p + j] * ahead[-j]
            past.append(now)
            ahead.append(np.zeros(len(coef)))
            psi[:, h] = 1.0 if h == 0 else sum((coef[:, i] * psi[:, h - i] for i in range(1, min(p, h) + 1)), coef[:, p + h] if h <= k else np.zeros(len(coef)))
        out = np.stack(past[-steps:], axis=1)
        for level in reversed(range(d)):
            out, psi = differences[level][:, -1:] + np.cumsum(out, axis=1), np.cumsum(psi, axis=1)
        return out, np.sqrt(np.cumsum(psi ** 2, axis=1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            if not m:
                continue
            levels, residuals = ends(pdf, "levels"), ends(pdf, "residuals")
            best, chosen = np.full(m, np.inf), np.full(m, -1)
            paths, widths = np.repeat(np.nan_to_num(levels[:, -1:]), steps, axis=1), np.full((m, steps), np.nan)
            fit = np.flatnonzero(pdf["xx"].notna().to_numpy())
            if len(fit):
                some = pdf.iloc[fit]
                n, yy = some["n"].to_numpy(dtype=float), np.array([v[0] for v in some["yy"]])
                xx, xy = full_matrices(np.stack(some["xx"].to_list()), size), np.stack([v[0] for v in some["xy"]])
                for at, (p, k) in enumerate(grid):
                    cols = [0, *range(1, p + 1), *range(1 + most_p, 1 + most_p + k)]
                    fits = solve_systems(xx[:, cols][:, :, cols], xy[:, cols], yy)
                    with np.errstate(all="ignore"):
                        ahead, spread = path(p, k, fits.coef, levels[fit], residuals[fit])
                        aic = information(n, fits.sse, len(cols))
                        better = (n > len(cols) + 1) & np.isfinite(ahead).all(axis=1) & (aic < best[fit])
                        width = np.sqrt(fits.sse / (n - len(cols)))[:, None] * spread
                    to = fit[better]
                    best[to], chosen[to], paths[to], widths[to] = aic[better], at, ahead[better], width[better]
            unit = pdf["unit"].to_numpy(dtype=float)[:, None]
            level, half = paths * unit, Z95 * widths * unit
            out = pdf[[*keys, "last_date"]].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            order_of = lambda i: pd.array([grid[c][i] if c >= 0 else None for c in np.repeat(chosen, steps)], "Int32")
            yield out.assign(step=np.tile(np.arange(1, steps + 1, dtype=np.int32), m), p=order_of(0), q=order_of(1), aic=np.repeat(np.where(chosen >= 0, best, np.nan), steps),
                             forecast=level.ravel(), lower=(level - half).ravel(), upper=(level + half).ravel())

    out = ready.mapInPandas(run, f"{_schema(ready, [*keys, 'last_date'])}, step int, p int, q int, aic double, forecast double, lower double, upper double")
    return out.select(*by, F.add_months("last_date", F.col("step")).alias(order), "step", "p", "q",
                      *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("aic", "forecast", "lower", "upper")])
