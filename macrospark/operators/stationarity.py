"""Augmented Dickey-Fuller test with a lag count chosen for each series (TSO9).

The products of all columns (lagged changes, level, change) are summed once for each series and difference order. From this one matrix the models
with 0, 1, 2 ... lagged changes follow one another: each lag adds a column to the Cholesky factor, beside which the rows of level and change are
carried on, so that the test statistic and the residuals of every lag count come without solving anew."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, ordered, q, spread_rows
from macrospark.constants import DF_CRITICAL_5PCT
from macrospark.operators.forecast import EXACT_FIT, _schema, difference_columns, full_matrices, information

#: A lag whose own variation is below this share of its square sum is taken for a combination of the others.
COLLINEAR = 1e-10


def adf_sums(df: DataFrame, orders: Sequence[int], lags: int, key: Names, order: str, value: str) -> DataFrame:
    """Per series and difference order d: values{d} (how many there are), n{d} (rows complete with all lags) and g{d}, the upper triangle of the products of one, the lagged changes,
    the level and the change. Values are divided by their mean size, which the statistic does not see."""
    keys = names(key)
    by, w = [q(c) for c in keys], ordered(keys, order)
    unit = F.coalesce(F.nullif(F.avg(F.abs(q(value))).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(1.0))
    scaled = df.filter(q(value).isNotNull()).select(*by, q(order), (q(value).cast("double") / unit).alias("_v"))
    staged = difference_columns(scaled, max(orders), keys, order, "_v")
    ago = lambda d, k: F.lag(f"_d{d}", k).over(w) if k else F.col(f"_d{d}")
    rows = staged.select(*by, *[F.col(f"_d{d}") for d in orders], *[F.when(ago(d, lags + 1).isNotNull(), F.array(
        F.lit(1.0), *[ago(d, k) - ago(d, k + 1) for k in range(1, lags + 1)], ago(d, 1), ago(d, 0) - ago(d, 1))).alias(f"_x{d}") for d in orders])
    size = lags + 3

    def sums(d: int) -> list[Column]:
        x = F.col(f"_x{d}")
        return [F.count(f"_d{d}").alias(f"values{d}"), F.count(x).alias(f"n{d}"),
                F.array(*[F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)) for i in range(size) for j in range(i, size)]).alias(f"g{d}")]

    return rows.groupBy(*by).agg(*[c for d in orders for c in sums(d)])


def best_lags(n: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lag count of the least AIC (the lowest one, if several) and the statistic of the level with it, for many systems at once; the statistic is
    NaN where no count leaves a residual degree of freedom, or the fit is exact."""
    m, size = g.shape[:2]
    lags = size - 3
    rest = g.copy()  # what is left of the products once the columns so far are taken out
    best, chosen, t = np.full(m, np.inf), np.zeros(m, np.int64), np.full(m, np.nan)
    alive = np.ones(m, bool)
    with np.errstate(all="ignore"):
        for k in range(lags + 1):
            pivot = rest[:, k, k]
            alive &= pivot > COLLINEAR * g[:, k, k]
            factor = rest[:, k] / np.sqrt(np.where(pivot > 0, pivot, 1.0))[:, None]
            rest = np.where(alive[:, None, None], rest - factor[:, :, None] * factor[:, None, :], rest)
            if k == 0:
                total = rest[:, -1, -1].copy()
            level, cross, p = rest[:, -2, -2], rest[:, -2, -1], k + 2
            sse = rest[:, -1, -1] - cross ** 2 / level
            aic = information(n, sse, p)
            better = alive & (n > p) & (level > COLLINEAR * g[:, -2, -2]) & (aic < best)
            best, chosen = np.where(better, aic, best), np.where(better, k, chosen)
            now = np.where(sse > EXACT_FIT * total, cross / level / np.sqrt(sse / (n - p) / level), np.nan)
            t = np.where(better, now, t)
    return chosen, t


def augmented_order(
    df: DataFrame, max_d: int = 2, max_lags: int = 4, minimum: int = 20, critical: float = DF_CRITICAL_5PCT,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """TSO9: the lowest difference order whose augmented statistic is below the critical value, with lags{d} (chosen by AIC over rows complete for all of `max_lags`) and t{d} of
    each order. The search stops at an order with under `minimum` values, and at `max_d`."""
    keys = names(key)
    orders = list(range(max_d + 1))
    sums = spread_rows(adf_sums(df, orders, max_lags, keys, order, value), keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out, d_of, done = pdf[keys].copy(), np.full(len(pdf), max_d), np.zeros(len(pdf), bool)
            for d in orders:
                n = pdf[f"n{d}"].to_numpy(dtype=float)
                lags, t = best_lags(n, full_matrices(np.stack(pdf[f"g{d}"].to_list()), max_lags + 3))
                out[f"n{d}"], out[f"lags{d}"], out[f"t{d}"] = pdf[f"n{d}"], lags, t
                stop = ~done & ((pdf[f"values{d}"].to_numpy() < minimum) | (t < critical))
                d_of, done = np.where(stop, d, d_of), done | stop
            yield out.assign(d=d_of)

    return sums.mapInPandas(solve, f"{_schema(sums, keys)}, " + ", ".join(f"n{d} bigint, lags{d} bigint, t{d} double" for d in orders) + ", d bigint").withColumns(
        {f"t{d}": F.when(~F.isnan(f"t{d}"), F.col(f"t{d}")) for d in orders})
