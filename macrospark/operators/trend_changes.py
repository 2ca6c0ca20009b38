"""Regression on a trend that may change, season and regressors (TSO13). The trend is a line plus hinges at even places of the series' span; the hinges' slopes
carry an L1 penalty, which the Bayesian information criterion, in its form for short series, picks from a path. Intercept, line, season and regressors are taken out of the sums of
products first, so that the path works on the hinges alone; many series go through coordinate descent together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, finite, names, q, spread_rows
from macrospark.operators.forecast import Z95, _schema, fill_columns, future_exogenous, seasonal_design

#: Relative size below which a gradient's excess, a column's own variation or a residual counts as rounding.
TINY = 1e-9
#: Gap in the optimality conditions, over the largest gradient without hinges, that counts as none.
CLOSE = 1e-7
#: Added to the unit diagonal of a system of hinges, of which several may stand between two neighbouring rows; each step starts from the true gradient, so that this slows the approach only.
RIDGE = 1e-10
#: Series fitted at a time: a fit holds some ten matrices of hinges for each, and an Arrow batch may bring ten thousand.
TOGETHER = 512


@dataclass(frozen=True)
class TrendChanges:
    """`changes` hinges, evenly over the first `share` of the span; `pairs` yearly sin/cos pairs; a path of `path` penalties down to `least` of the largest."""
    changes: int = 25
    share: float = 0.8
    pairs: int = 3
    path: int = 20
    least: float = 1e-3

    @property
    def knots(self) -> np.ndarray:
        return self.share * np.arange(1, self.changes + 1) / self.changes


def _soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def _gaps(g: np.ndarray, c: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    gradient, lam = c - np.einsum("mij,mj->mi", g, beta), penalty[:, None]
    return np.where(beta != 0, np.abs(gradient - np.sign(beta) * lam), np.maximum(np.abs(gradient) - lam, 0.0))


def violations(g: np.ndarray, c: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """How far the slopes of each system are from the optimality conditions: gradients at most the penalty, and equal to it, with the slope's sign, where a slope is not zero."""
    return _gaps(g, c, beta, penalty).max(axis=1)


def descend(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, beta: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Slopes of least squares with an L1 penalty, from sums of products, many systems at once. Each round moves the one coordinate of a system that is farthest from its optimality condition; then the system
    of the hinges in use is solved outright, and the slopes go towards its solution, dropping one hinge after another that would change its sign. No part of this raises the
    objective. A series that meets the conditions leaves the batch."""
    beta, todo, p = beta.copy(), np.arange(len(c)), c.shape[1]
    bound = CLOSE * np.abs(c).max(axis=1, initial=0.0)
    for _ in range(rounds):
        gs, cs, b, lam = g[todo], c[todo], beta[todo], penalty[todo]
        far = _gaps(gs, cs, b, lam)
        open_ = far.max(axis=1) > bound[todo]
        todo, gs, cs, b, lam, far = todo[open_], gs[open_], cs[open_], b[open_], lam[open_], far[open_]
        if not len(todo):
            break
        rows, k = np.arange(len(todo)), far.argmax(axis=1)
        own = gs[rows, k, k]
        b[rows, k] = _soft(cs[rows, k] - np.einsum("mj,mj->m", gs[rows, k], b) + own * b[rows, k], lam) / own
        move_on = rows
        for _ in range(p + 1):
            gm, bm = gs[move_on], b[move_on]
            used = bm != 0
            size = np.where(used, np.sqrt(np.maximum(np.einsum("mii->mi", gm), 0.0)), 1.0)
            system = np.where(used[:, :, None] & used[:, None, :], gm / size[:, :, None] / size[:, None, :], 0.0) + np.eye(p) * np.where(used, RIDGE, 1.0)[:, None, :]
            left = np.where(used, cs[move_on] - np.einsum("mij,mj->mi", gm, bm) - lam[move_on, None] * np.sign(bm), 0.0)
            move = np.linalg.solve(system, (left / size)[:, :, None])[:, :, 0] / size
            turns = used & (np.sign(bm + move) != np.sign(bm))
            with np.errstate(all="ignore"):
                reach = np.where(turns, np.abs(bm / move), np.inf)
            first = reach.min(axis=1)
            b[move_on] = np.where(turns & (reach <= first[:, None]), 0.0, bm + np.minimum(first, 1.0)[:, None] * move)
            move_on = move_on[turns.any(axis=1)]
            if not len(move_on):
                break
        beta[todo] = b
    return beta


def fit_batch(designs: Sequence[np.ndarray], hinges: Sequence[np.ndarray], values: Sequence[np.ndarray], settings: TrendChanges) -> dict[str, np.ndarray]:
    """Fits of many series: coefficients of the free columns, slopes of the hinges, the penalty chosen and the largest useful one, how far the solution is from optimal, residual variance."""
    m, free, k = len(values), designs[0].shape[1], settings.changes
    n = np.array([len(v) for v in values], dtype=float)
    mid = np.array([v.mean() for v in values])
    unit = np.array([max(np.abs(v - a).mean(), 1e-300) if len(v) else 1.0 for v, a in zip(values, mid)])
    ys = [(v - a) / u for v, a, u in zip(values, mid, unit)]
    uh, uy = (np.empty((m, free, k)), np.empty((m, free)))
    uu, hh, hy, yy = np.empty((m, free, free)), np.empty((m, k, k)), np.empty((m, k)), np.empty(m)
    for i, (u, h, y) in enumerate(zip(designs, hinges, ys)):
        uu[i], uh[i], uy[i], hh[i], hy[i], yy[i] = u.T @ u, u.T @ h, u.T @ y, h.T @ h, h.T @ y, y @ y
    scale = np.sqrt(np.maximum(np.einsum("mii->mi", uu), 1e-300))
    outer = scale[:, :, None] * scale[:, None, :]
    rank = np.linalg.matrix_rank(uu / outer, tol=1e-10, hermitian=True)
    inverse = np.linalg.pinv(uu / outer, rcond=1e-10, hermitian=True) / outer
    g = hh - np.einsum("mfi,mfe,mej->mij", uh, inverse, uh)
    c = hy - np.einsum("mfi,mfe,me->mi", uh, inverse, uy)
    left = np.maximum(yy - np.einsum("mf,mfe,me->m", uy, inverse, uy), 0.0)
    allowed = np.einsum("mii->mi", g) > TINY * np.einsum("mii->mi", hh)
    c, g = np.where(allowed, c, 0.0), np.where(allowed[:, :, None] & allowed[:, None, :], g, 0.0)  # a hinge that the free columns explain is none
    possible = n > rank + 1
    largest = np.where(possible & (left > TINY * np.maximum(yy, 1e-300)), np.abs(c).max(axis=1, initial=0.0), 0.0)
    best, beta, kept, penalty = np.full(m, np.inf), np.zeros((m, k)), np.zeros((m, k)), largest.copy()
    at = np.flatnonzero(largest > 0)
    for step in range(settings.path if len(at) else 0):
        lam = largest[at] * settings.least ** (step / max(settings.path - 1, 1))
        beta[at] = descend(g[at], c[at], lam, beta[at]) if step else 0.0
        b = beta[at]
        sse = left[at] - 2 * np.einsum("mi,mi->m", b, c[at]) + np.einsum("mi,mij,mj->m", b, g[at], b)
        used = rank[at] + (b != 0).sum(axis=1)
        spare = n[at] - used - 2
        score = n[at] * np.log(np.maximum(sse, TINY * left[at]) / n[at]) + n[at] * used * np.log(n[at]) / np.maximum(spare, 1)
        better = (score < best[at]) & (spare > 0)
        to = at[better]
        best[to], kept[to], penalty[to] = score[better], b[better], lam[better]
    coef = np.einsum("mfe,me->mf", inverse, uy - np.einsum("mfi,mi->mf", uh, kept))
    sse = np.maximum(left - 2 * np.einsum("mi,mi->m", kept, c) + np.einsum("mi,mij,mj->m", kept, g, kept), 0.0)
    spare = n - rank - (kept != 0).sum(axis=1)
    away = violations(g, c, kept, penalty) / np.where(largest > 0, largest, 1.0)
    coef = coef * unit[:, None]
    coef[:, 0] += mid
    return {"coef": coef, "slopes": kept * unit[:, None], "penalty": np.where(possible, penalty * unit, np.nan), "largest_penalty": np.where(possible, largest * unit, np.nan),
            "violation": np.where(possible, np.where(largest > 0, away, 0.0), np.nan), "sigma2": np.where(spare > 0, sse * unit ** 2 / np.maximum(spare, 1), np.nan)}


def _place(order: str) -> Column:
    """Where a date stands in the span of its series, 0 at the start and 1 at the end."""
    return F.datediff(q(order), F.col("start")) / F.col("span")


def _free(order: str, regressors: Sequence[str], settings: TrendChanges) -> list[Column]:
    season = seasonal_design(F.col("start"), q(order), settings.pairs)
    return [F.lit(1.0), _place(order), *[c for n, c in season.items() if n != "trend_years"], *[finite(q(r).cast("double")) for r in regressors]]


def fit_trend_changes(
    df: DataFrame, regressors: Sequence[str] = (), settings: TrendChanges = TrendChanges(), key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """One row per series: start, span (days), n, coef (intercept, slope over the span, season, regressors), slopes (one for each hinge, over the span), penalty, largest_penalty (from which on no
    hinge is used), violation of the optimality conditions in its units, sigma2. Rows without value or regressor are left out; without spare rows there are no changes and the fit has minimum norm (penalties, violation null).

    The rows of a series, which the calendar bounds, are packed into one row: one shuffle, and no product of columns is spelled out as a row."""
    keys = names(key)
    by = [q(c) for c in keys]
    used = df.select(*by, q(order), *[q(r) for r in regressors], finite(q(value).cast("double")).alias("_y"))
    used = used.na.drop(subset=[order, "_y", *regressors])
    packed = used.groupBy(*by).agg(F.min(q(order)).alias("start"), F.greatest(F.datediff(F.max(q(order)), F.min(q(order))), F.lit(1)).alias("span"),
                                   F.array_sort(F.collect_list(F.struct(q(order).alias("d"), F.col("_y").alias("y"), *[q(r).cast("double").alias(f"r{i}") for i, r in enumerate(regressors)]))).alias("_rows"))
    season = lambda date: [c for n, c in seasonal_design(F.col("start"), date, settings.pairs).items() if n != "trend_years"]
    flat = spread_rows(packed, keys).select(*by, "start", "span", F.transform("_rows", lambda s: s["y"]).alias("_y"), F.flatten(F.transform("_rows", lambda s: F.array(
        F.lit(1.0), F.datediff(s["d"], F.col("start")) / F.col("span"), *season(s["d"]), *[s[f"r{i}"] for i in range(len(regressors))]))).alias("_u"))
    free = 2 + 2 * settings.pairs + len(regressors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole[a:a + TOGETHER] for whole in batches for a in range(0, len(whole), TOGETHER)):
            values = [np.asarray(v, dtype=float) for v in pdf["_y"]]
            designs = [np.asarray(v, dtype=float).reshape(-1, free) for v in pdf["_u"]]
            hinges = [np.maximum(u[:, 1:2] - settings.knots, 0.0) for u in designs]
            fit = fit_batch(designs, hinges, values, settings)
            yield pdf[[*keys, "start", "span"]].assign(n=[len(v) for v in values], coef=list(fit["coef"]), slopes=list(fit["slopes"]),
                                                       **{c: fit[c] for c in ("penalty", "largest_penalty", "violation", "sigma2")})

    doubles = ("penalty", "largest_penalty", "violation", "sigma2")
    out = flat.mapInPandas(run, f"{_schema(flat, [*keys, 'start', 'span'])}, n bigint, coef array<double>, slopes array<double>, " + ", ".join(f"{c} double" for c in doubles))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def trend_changes(fit: DataFrame, settings: TrendChanges = TrendChanges(), key: Names = KEY) -> DataFrame:
    """The changes of each series: date and change of the slope per year."""
    knots = F.array(*[F.lit(float(k)) for k in settings.knots])
    rows = fit.select(*[q(c) for c in names(key)], "start", "span", F.posexplode("slopes").alias("_at", "_slope")).filter(F.col("_slope") != 0)
    return rows.select(*[q(c) for c in names(key)], F.date_add("start", F.round(F.get(knots, F.col("_at")) * F.col("span")).cast("int")).alias("date"),
                       (F.col("_slope") / F.col("span") * 365.25).alias("change_per_year"))


def predict_trend_changes(
    rows: DataFrame, fit: DataFrame, regressors: Sequence[str] = (), settings: TrendChanges = TrendChanges(), key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """Adds trend, forecast, lower and upper, in the JVM. The 95 % interval holds the residual variance and, past the end of the series, changes still to come, as frequent as the hinges and, like them, of
    Laplace size with their mean: their variance grows with the third power of the time ahead. It is null without residual degrees of freedom."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    joined = rows.join(fit.select(*[q(c) for c in names(key)], "start", "span", "coef", "slopes", "sigma2"), names(key))
    u = _place(order)
    hinges = F.array(*[F.greatest(u - float(k), F.lit(0.0)) for k in settings.knots])
    bends = total(F.zip_with("slopes", hinges, lambda a, b: a * b))
    design = F.array(*[F.coalesce(c, F.lit(0.0)) for c in _free(order, regressors, settings)])
    size = total(F.transform("slopes", lambda s: F.abs(s))) / settings.changes
    ahead = F.greatest(u - 1.0, F.lit(0.0))
    joined = joined.withColumns({
        "trend": F.get("coef", F.lit(0)) + F.get("coef", F.lit(1)) * u + bends, "forecast": total(F.zip_with("coef", design, lambda a, b: a * b)) + bends,
        "_half": Z95 * F.sqrt(F.col("sigma2") + settings.changes / settings.share * 2 * size * size * F.pow(ahead, F.lit(3.0)) / 3)})
    return (joined.withColumns({"lower": F.col("forecast") - F.col("_half"), "upper": F.col("forecast") + F.col("_half")})
            .drop("start", "span", "coef", "slopes", "sigma2", "_half"))


def trend_change_forecast(
    df: DataFrame, steps: int, regressors: Sequence[str] = (), future_regressors: DataFrame | None = None, settings: TrendChanges = TrendChanges(),
    key: Names = KEY, order: str = ORDER, value: str = VALUE, forecast_key: Names | None = None,
) -> DataFrame:
    """TSO13 with changes of trend: fit on the history, forecast `steps` months. Regressors come from `future_regressors` where it has them and else keep their last value."""
    keys = names(key)
    filled = fill_columns(df, regressors, keys, order) if regressors else df
    fit = fit_trend_changes(filled, regressors, settings, keys, order, value)
    future = future_exogenous(filled.select(*[q(c) for c in [*keys, order, *regressors]]), steps, regressors, future_regressors, keys, order, forecast_key)
    return predict_trend_changes(future, fit, regressors, settings, keys, order).select(*[q(c) for c in keys], q(order), "step", "trend", "forecast", "lower", "upper")


def optimality(
    df: DataFrame, fit: DataFrame, regressors: Sequence[str] = (), settings: TrendChanges = TrendChanges(), key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """Checks a fit on the rows themselves: n, `excess` (the largest gap in the optimality conditions of a hinge, over the largest penalty) and `cosine` (the largest between the residuals and a free column)."""
    by = [q(c) for c in names(key)]
    rows = predict_trend_changes(df.na.drop(subset=[order, value, *regressors]), fit, regressors, settings, key, order)
    rows = rows.join(fit.select(*by, "start", "span", "slopes", "penalty", "largest_penalty"), names(key)).withColumn("_r", q(value) - F.col("forecast"))
    hinges = [F.greatest(_place(order) - float(k), F.lit(0.0)) for k in settings.knots]
    free = _free(order, regressors, settings)
    sums = rows.groupBy(*by, "penalty", "largest_penalty", "slopes").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(h * F.col("_r")) for h in hinges]).alias("_g"),
        F.greatest(*[F.abs(F.try_divide(F.sum(c * F.col("_r")), F.sqrt(F.sum(c * c) * F.sum(q(value) * q(value))))) for c in free]).alias("cosine"))
    gap = lambda g, s: F.when(s != 0, F.abs(g - F.signum(s) * F.col("penalty"))).otherwise(F.greatest(F.abs(g) - F.col("penalty"), F.lit(0.0)))
    return sums.select(*by, "n", F.try_divide(F.array_max(F.zip_with("_g", "slopes", gap)), F.col("largest_penalty")).alias("excess"), "cosine")
