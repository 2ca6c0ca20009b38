"""Vector autoregressions with regressors, order by AIC (TSO15).

A key's series are period-grained, so its rows fit into one packed row. Of the largest model there is one matrix of products; sweeping it column by column
passes through all nested models (regressors, then one lag after the other), each with its coefficients and residual products in place."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from macrospark.columns import KEY, ORDER, Names, finite, names, q, spread_rows
from macrospark.operators.forecast import _schema

#: Variation below this share of the square sum is rounding: the column is a combination of earlier ones, or constant.
FLAT = 1e-10


def filled(values: np.ndarray) -> np.ndarray:
    """Columns filled forward, then backward; 0 where nothing is known."""
    return pd.DataFrame(values).ffill().bfill().fillna(0.0).to_numpy()


def ranked_regressors(targets: np.ndarray, candidates: np.ndarray, most: int) -> list[int]:
    """AGG9 for one key: places of the candidates with the greatest sum of absolute correlations with the targets (0 where one is
    constant), best first, ties in the given order."""
    def unit(x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(axis=0)
        size = np.sqrt((centred ** 2).sum(axis=0))
        flat = size ** 2 <= FLAT * (x ** 2).sum(axis=0)
        return np.where(flat, 0.0, centred / np.where(flat, 1.0, size))

    if not len(targets) or not candidates.shape[1]:
        return []
    score = np.abs(unit(candidates).T @ unit(targets)).sum(axis=1).round(9)
    return np.argsort(-score, kind="stable")[:most].tolist()


def sweep(a: np.ndarray, k: int) -> None:
    """Sweep a symmetric matrix of products on column k, in place."""
    pivot = a[k, k]
    row = a[k] / pivot
    column = a[:, k].copy()
    a -= np.outer(column, row)
    a[k], a[:, k] = row, column / pivot * -1.0
    a[k, k] = 1.0 / pivot


@dataclass
class VectorFit:
    """p lags, the design columns used, their coefficients (one column per series) and how near the residuals are to being orthogonal to them."""
    p: int
    columns: list[int]
    coef: np.ndarray
    cosine: float


def design(work: np.ndarray, regressors: np.ndarray, lags: int) -> np.ndarray:
    """One, the regressors, then the lags of all series, for the rows that have all `lags`."""
    n = max(0, len(work) - lags)
    return np.hstack([np.ones((n, 1)), regressors[len(work) - n:], *[work[lags - i:lags - i + n] for i in range(1, lags + 1)]])


def fit_orders(work: np.ndarray, regressors: np.ndarray, orders: Sequence[int]) -> VectorFit | None:
    """The order of the least AIC; null without one that leaves residual degrees of freedom. All orders use the same rows."""
    most = max(orders)
    x = design(work, regressors, most)
    y = work[len(work) - len(x):]
    n, k = y.shape
    if n < 3:
        return None
    first = 1 + regressors.shape[1]
    both = np.hstack([x, y])
    scale = np.sqrt((both ** 2).sum(axis=0))
    scale[scale == 0] = 1.0
    products = (both / scale).T @ (both / scale)
    swept, used, best, out = products.copy(), [], np.inf, None
    for p in range(0, most + 1):
        for c in range(0 if p == 0 else first + (p - 1) * k, first + p * k):
            if swept[c, c] > FLAT:  # else earlier columns explain it
                sweep(swept, c)
                used.append(c)
        if p in orders and n > len(used):
            left = swept[x.shape[1]:, x.shape[1]:]
            sign, log_det = np.linalg.slogdet(left / n + np.eye(k) * 1e-15)
            aic = n * (log_det + 2 * np.log(scale[x.shape[1]:]).sum()) + 2 * k * (len(used) + (k + 1) / 2)
            if aic < best:
                coef = swept[used][:, x.shape[1]:] * scale[x.shape[1]:] / scale[used][:, None]
                best, out = aic, (p, list(used), coef)
    if out is None:
        return None
    p, used, coef = out
    residual = y - x[:, used] @ coef
    size = np.sqrt((residual ** 2).sum(axis=0)) * scale[used][:, None]
    live = (residual ** 2).sum(axis=0) > FLAT * (y ** 2).sum(axis=0)
    cosine = np.abs(x[:, used].T @ residual) / np.where(size > 0, size, 1.0)
    return VectorFit(p, used, coef, float(cosine[:, live].max(initial=0.0)))


def _packed(df: DataFrame, columns: Sequence[str], keys: list[str], order: str) -> DataFrame:
    """One row per key: last_date and its values by date; period-grained, so bounded by the calendar."""
    rows = F.array_sort(F.collect_list(F.struct(q(order).alias("_at"), F.array(*[finite(q(c).cast("double")) for c in columns]).alias("_v"))))
    packed = df.groupBy(*[q(c) for c in keys]).agg(F.max(q(order)).alias("last_date"), rows.alias("_rows"))
    return spread_rows(packed.withColumn("_rows", F.transform("_rows", lambda r: r["_v"])), keys)


class _Key:
    """One key's series: levels and regressors filled and scaled to mean size 1, differences taken."""

    def __init__(self, rows, k: int, orders: np.ndarray, most: int):
        values = filled(np.array([np.array(r, dtype=float) for r in rows]))
        self.unit = np.abs(values).mean(axis=0)
        self.unit[self.unit == 0] = 1.0
        scaled = values / self.unit
        self.picked = ranked_regressors(scaled[:, :k], scaled[:, k:], most)
        self.levels, self.regressors, self.orders = scaled[:, :k], scaled[:, [k + c for c in self.picked]], orders
        cut = int(orders.max(initial=0))
        self.work = np.stack([np.diff(self.levels[:, i], n=d)[max(0, cut - d):] if len(scaled) > cut else np.empty(0) for i, d in enumerate(orders)], axis=1)
        self.regressors = self.regressors[len(scaled) - len(self.work):]

    def forecast(self, fit: VectorFit, steps: int) -> np.ndarray:
        """Levels step by step; regressors keep their last value, differences are added up."""
        past, k = [*self.work[len(self.work) - max(fit.p, 1):]], self.work.shape[1]
        tails = [[np.diff(self.levels[:, i], n=j)[-1] for j in range(d)] for i, d in enumerate(self.orders)]
        out = np.empty((steps, k))
        for h in range(steps):
            x = np.concatenate([[1.0], self.regressors[-1], *[past[-i] for i in range(1, fit.p + 1)]])
            past.append(x[fit.columns] @ fit.coef)
            for i, tail in enumerate(tails):
                value = past[-1][i]
                for j in reversed(range(len(tail))):
                    value = tail[j] = tail[j] + value
                out[h, i] = value
        return out * self.unit[:k]


def _each(df: DataFrame, series, candidates, orders, d, most, keys, order, schema: str, give) -> DataFrame:
    differences = np.array([d if isinstance(d, int) else d.get(c, 0) for c in series])
    if ((differences < 0) | (differences > 2)).any():
        raise ValueError("difference order must be 0, 1 or 2")
    packed = _packed(df, [*series, *candidates], keys, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, rows in enumerate(pdf["_rows"]):
                own = _Key(rows, len(series), differences, most)
                got = give(own, fit_orders(own.work, own.regressors, orders) if len(own.work) > max(orders) else None)
                head = pdf[[*keys, "last_date"]].iloc[[at] * len(got)].reset_index(drop=True)
                yield pd.concat([head, got], axis=1)

    return packed.mapInPandas(run, f"{_schema(packed, [*keys, 'last_date'])}, {schema}")


def vector_model_forecast(
    df: DataFrame, series: Sequence[str], steps: int, candidates: Sequence[str] = (), orders: Sequence[int] = (1, 2, 3, 4),
    d: Mapping[str, int] | int = 0, most: int = 10, key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """TSO15: one vector autoregression per key over the panel columns `series`, with up to `most` regressors chosen for the key among `candidates` (AGG9) and the number of lags with
    the least AIC of `orders`. Columns are differenced up to twice (`d`) and added up again. Regressors keep their last value. Rows are (key, date, step, p, one column
    per series); a key too short for any order gives its last values (p is null)."""
    keys = names(key)

    def give(own: _Key, fit: VectorFit | None) -> pd.DataFrame:
        path = own.forecast(fit, steps) if fit else np.repeat(own.levels[-1:] * own.unit[:len(series)], steps, axis=0)
        out = pd.DataFrame({"step": np.arange(1, steps + 1, dtype=np.int32), "p": pd.array([fit.p if fit else None] * steps, "Int32")})
        return out.assign(**{c: path[:, i] for i, c in enumerate(series)})

    out = _each(df, series, candidates, orders, d, most, keys, order, "step int, p int, " + ", ".join(f"`{c}` double" for c in series), give)
    return out.select(*[q(c) for c in keys], F.add_months("last_date", F.col("step")).alias(order), "step", "p", *[q(c) for c in series])


def vector_model_fits(
    df: DataFrame, series: Sequence[str], candidates: Sequence[str] = (), orders: Sequence[int] = (1, 2, 3, 4),
    d: Mapping[str, int] | int = 0, most: int = 10, key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """The fits behind `vector_model_forecast`: per key its regressors (best first), n (rows of the fit), p and the greatest cosine between a residual and a design column,
    0 but for rounding where the normal equations hold."""
    keys = names(key)

    def give(own: _Key, fit: VectorFit | None) -> pd.DataFrame:
        return pd.DataFrame({"regressors": [",".join(candidates[c] for c in own.picked)], "n": [max(0, len(own.work) - max(orders))],
                             "p": pd.array([fit.p if fit else None], "Int32"), "largest_cosine": [fit.cosine if fit else np.nan]})

    out = _each(df, series, candidates, orders, d, most, keys, order, "regressors string, n bigint, p int, largest_cosine double", give)
    return out.drop("last_date")
