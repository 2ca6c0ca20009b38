"""Forecasting by distributed least squares (TSO8-TSO16, TSO19).

The data side is Spark: design columns come from windows, and every model is fitted
from sums of products (a Gram matrix) that one combinable aggregation makes per
series. What is left per series is a matrix with a handful of rows; those small
systems are solved in Arrow batches, many series at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, back_from_end, finite, names, ordered, q, spread, spread_rows, upto
from macrospark.constants import DF_CRITICAL_5PCT
from macrospark.functions.scalar import positive_shift
from macrospark.operators.joins import repeat_last
from macrospark.operators.windows import fill_both

Z95 = 1.959963984540054
#: Share of the total variation below which a residual sum of squares is taken for rounding.
EXACT_FIT = 1e-6


# --- Box-Cox (TSO8) -------------------------------------------------------------

def box_cox_lambda(
    df: DataFrame, lo: float = -2.0, hi: float = 2.0, step: float = 0.05, key: Names = KEY, value: str = VALUE,
    refine: bool = True,
) -> DataFrame:
    """TSO8: lambda of the highest log-likelihood on a grid, per series, with the shift
    that makes the series positive; `refine` adds a grid ten times finer around it.
    The grid is exploded inside the stage that already holds a series together, so
    the multiplied rows are folded at once and never shuffled. A task holds a group for each
    series and lambda, so there are more tasks than for plain windows."""
    keys = names(key)
    by = [q(c) for c in keys]
    lowest = F.min(q(value)).over(Window.partitionBy(*by))
    rows = (spread(df, keys, 4).select(*by, q(value).cast("double").alias("_raw"), positive_shift(lowest).alias("shift"))
            .select(*by, "shift", (F.col("_raw") + F.col("shift")).alias("_x"))
            .select(*by, "shift", "_x", F.ln("_x").alias("_ln")))

    def best(frame: DataFrame, grid: Column) -> DataFrame:
        tried = frame.select("*", F.explode(grid).alias("_lam"))
        y = F.when(F.col("_lam") == 0, F.col("_ln")).otherwise(
            F.try_divide(F.exp(F.col("_lam") * F.col("_ln")) - 1.0, F.col("_lam")))
        scored = tried.groupBy(*by, "shift", "_lam").agg(
            ((F.first("_lam") - 1.0) * F.sum("_ln") - F.count("_ln") / 2.0 * F.ln(F.var_pop(y))).alias("_llf"))
        return scored.groupBy(*by, "shift").agg(
            F.max_by("_lam", "_llf").alias("lambda"), F.max("_llf").alias("log_likelihood"))

    count = int(round((hi - lo) / step))
    found = best(rows, F.array(*[F.lit(round(lo + i * step, 10)) for i in range(count + 1)]))
    if refine:
        near = rows.join(found.select(*by, F.col("lambda").alias("_c")), keys)
        found = best(near, F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda j: F.col("_c") + j * F.lit(step / 10)))
    return found


# --- stationarity (TSO9) --------------------------------------------------------

def difference_columns(df: DataFrame, d: int, key: Names, order: str, value: str) -> DataFrame:
    """Columns _d0.._d{d}: the series and its differences."""
    w = ordered(key, order)
    out = df.withColumn("_d0", q(value).cast("double"))
    for i in range(1, d + 1):
        out = out.withColumn(f"_d{i}", F.col(f"_d{i - 1}") - F.lag(f"_d{i - 1}", 1).over(w))
    return out


def dickey_fuller(df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE, d: int = 0) -> DataFrame:
    """TSO9: t-statistic of the lagged level in a regression of the change on it; null where the fit is
    undetermined or exact (fewer than three changes, or residuals lost in rounding)."""
    return _df_stats(df, [d], key, order, value).withColumnsRenamed({f"t{d}": "t_stat", f"n{d}": "n"})


def _df_stats(df: DataFrame, orders: Sequence[int], key: Names, order: str, value: str) -> DataFrame:
    keys = names(key)
    w = ordered(keys, order)
    staged = difference_columns(df.filter(q(value).isNotNull()), max(orders), keys, order, value)
    pairs = staged.select(*[q(c) for c in keys], *[
        x for d in orders for x in (
            F.lag(f"_d{d}", 1).over(w).alias(f"_x{d}"),
            (F.col(f"_d{d}") - F.lag(f"_d{d}", 1).over(w)).alias(f"_y{d}"))])
    aggs = []
    for d in orders:
        y, x = F.col(f"_y{d}"), F.col(f"_x{d}")
        aggs += [F.regr_count(y, x).alias(f"n{d}"), F.regr_slope(y, x).alias(f"_b{d}"),
                 F.regr_sxx(y, x).alias(f"_sxx{d}"), F.regr_syy(y, x).alias(f"_syy{d}"),
                 F.regr_sxy(y, x).alias(f"_sxy{d}")]
    sums = pairs.groupBy(*[q(c) for c in keys]).agg(*aggs)

    def t(d: int) -> Column:
        b = F.col(f"_b{d}")
        sse = F.col(f"_syy{d}") - b * F.col(f"_sxy{d}")
        var = F.try_divide(F.try_divide(sse, (F.col(f"n{d}") - 2).cast("double")), F.col(f"_sxx{d}"))
        return F.when((sse > EXACT_FIT * F.col(f"_syy{d}")) & (var > 0), b / F.sqrt(var))

    return sums.select(*[q(c) for c in keys], *[c for d in orders for c in (F.col(f"n{d}"), t(d).alias(f"t{d}"))])


def differencing_order(
    df: DataFrame, max_d: int = 2, minimum: int = 20, critical: float = DF_CRITICAL_5PCT,
    key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """TSO9: the lowest difference order whose statistic is below the critical value;
    the search stops at an order with under `minimum` values, and at `max_d`."""
    stats = _df_stats(df, list(range(max_d + 1)), key, order, value)
    chosen = F.lit(max_d)
    for d in reversed(range(max_d)):
        # n_d counts changes of the d-th difference: one less than its values.
        stop = (F.col(f"n{d}") + 1 < minimum) | F.coalesce(F.col(f"t{d}") < critical, F.lit(False))
        chosen = F.when(stop, F.lit(d)).otherwise(chosen)
    return stats.withColumn("d", chosen)


# --- least squares (TSO11) ------------------------------------------------------

def gram(
    df: DataFrame, xs: Sequence[str], y: Names, key: Names = KEY, intercept: bool = True
) -> DataFrame:
    """TSO11, first half: per key the row count, the upper triangle of X'X (with a
    leading column of ones), X'y and y'y for each dependent column. Only rows
    complete in all columns count. One combinable aggregation."""
    ys = names(y)
    rows = df.select(*[q(c) for c in names(key)], *[finite(q(c).cast("double")).alias(c) for c in dict.fromkeys([*xs, *ys])])
    rows = rows.na.drop(subset=list(dict.fromkeys([*xs, *ys])))
    design = ([F.lit(1.0)] if intercept else []) + [q(x) for x in xs]
    p = len(design)
    return rows.groupBy(*[q(c) for c in names(key)]).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(design[i] * design[j]) for i in range(p) for j in range(i, p)]).alias("xx"),
        F.array(*[F.array(*[F.sum(design[i] * q(v)) for i in range(p)]) for v in ys]).alias("xy"),
        F.array(*[F.sum(q(v) * q(v)) for v in ys]).alias("yy"))


def wide_gram(df: DataFrame, xs: Sequence[str], ys: Sequence[str], key: Names = KEY) -> DataFrame:
    """`gram` for many columns: each task multiplies the rows of a key that lie together as one matrix, adds the products up row by row and
    hands on one array of sums; a key's arrays, at most one of a task, are added up."""
    keys = names(key)
    by = [q(c) for c in keys]
    used = list(dict.fromkeys([*xs, *ys]))
    # Incomplete rows go in the tasks: filters on so many columns keep Spark's planner busy for minutes.
    rows = df.select(*by, *[q(c).cast("double").alias(c) for c in used]).sortWithinPartitions(*by)
    p, k = 1 + len(xs), len(ys)
    of_x, of_y = [used.index(c) for c in xs], [used.index(c) for c in ys]
    upper = np.triu_indices(p)
    alike = lambda values: [v if v == v else "nan" for v in values]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row, n, total = None, None, 0, np.zeros(0)

        def given(rows: list, counts: list, sums: list) -> pa.RecordBatch:
            columns = pa.Table.from_batches(rows).combine_chunks().to_batches()[0].columns
            return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], [*keys, "_n", "_sums"])

        for batch in batches:
            values = np.stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(len(used))], axis=1)
            complete = np.isfinite(values).all(axis=1)
            if not complete.any():
                continue
            own, values = batch.select(list(range(len(keys)))).filter(pa.array(complete)), values[complete]
            x, y = np.hstack([np.ones((len(values), 1)), values[:, of_x]]), values[:, of_y]
            labels = list(zip(*[alike(c.to_pylist()) for c in own.columns]))
            starts = [i for i, label in enumerate(labels) if not i or label != labels[i - 1]]
            done: tuple[list, list, list] = ([], [], [])
            for a, b in zip(starts, [*starts[1:], len(labels)]):
                u, v = x[a:b], y[a:b]
                sums = np.hstack([u[:, upper[0]] * u[:, upper[1]], (v[:, :, None] * u[:, None, :]).reshape(b - a, -1), v * v])
                if row is not None and labels[a] == last:
                    n, total = n + b - a, np.vstack([total, sums]).sum(axis=0)
                    continue
                if row is not None:
                    for column, held in zip(done, (row, n, total)):
                        column.append(held)
                last, row, n, total = labels[a], own.slice(a, 1), b - a, sums.sum(axis=0)
            if done[0]:
                yield given(*done)
        if row is not None:
            yield given([row], [n], [total])

    sums = rows.mapInArrow(fold, f"{_schema(rows, keys)}, _n bigint, _sums array<double>")
    none = F.array_repeat(F.lit(0.0), p * (p + 1) // 2 + p * k + k)
    whole = sums.groupBy(*by).agg(F.sum("_n").alias("n"), F.collect_list("_sums").alias("_parts")).select(*by, "n", F.when(
        F.size("_parts") == 1, F.col("_parts")[0]).otherwise(F.aggregate("_parts", none, lambda a, b: F.zip_with(a, b, lambda u, v: u + v))).alias("_all"))
    cells = p * (p + 1) // 2
    return whole.select(*by, "n", F.slice("_all", 1, cells).alias("xx"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(
        "_all", cells + 1 + i * p, p)).alias("xy"), F.slice("_all", cells + p * k + 1, k).alias("yy"))


@dataclass
class Fits:
    """Least-squares fits of many systems of one size."""
    coef: np.ndarray
    sse: np.ndarray
    inverse: np.ndarray


def full_matrices(triangles: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.zeros((len(triangles), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = triangles
    out[:, j, i] = triangles
    return out


def solve_systems(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> Fits:
    """Least squares from sums of products, all systems at once. Each is scaled to unit
    diagonal first; a singular one gets its minimum-norm solution."""
    scale = np.sqrt(np.einsum("mii->mi", xx))
    scale = np.where(scale > 0, scale, 1.0)
    outer = scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(xx / outer, rcond=1e-12, hermitian=True) / outer
    coef = np.einsum("mij,mj->mi", inverse, xy)
    return Fits(coef, np.maximum(yy - np.einsum("mi,mi->m", coef, xy), 0.0), inverse)


def information(n: np.ndarray, sse: np.ndarray, p: int) -> np.ndarray:
    """AIC of a Gaussian regression with p coefficients and a variance."""
    return n * np.log(np.maximum(sse, 1e-300) / n) + 2 * (p + 1)


def _schema(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in cols)


def least_squares(
    df: DataFrame, xs: Sequence[str], y: str, key: Names = KEY, intercept: bool = True, minimum_norm: bool = False
) -> DataFrame:
    """TSO11: per key the coefficients (intercept first), their t statistics, residual variance, AIC and the inverse of X'X
    (row by row). All are null for a key with fewer complete rows than coefficients, or its solution is the one of minimum norm."""
    keys = names(key)
    sums = spread_rows(gram(df, xs, y, key, intercept), keys)

    size = len(xs) + (1 if intercept else 0)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(dtype=float)
            fits = solve_systems(full_matrices(np.stack(pdf["xx"]), size), np.stack([v[0] for v in pdf["xy"]]),
                                 np.array([v[0] for v in pdf["yy"]], dtype=float))
            with np.errstate(divide="ignore", invalid="ignore"):
                var = np.where(n > size, fits.sse / (n - size), np.nan)
                error = np.sqrt(np.maximum(np.einsum("mii->mi", fits.inverse) * var[:, None], 0.0))
                t = np.where(error > 0, fits.coef / error, np.nan)
            known = (n >= size) | minimum_norm
            either = lambda rows: [v if k else None for v, k in zip(rows, known)]
            yield pdf[[*keys, "n"]].assign(coef=either(fits.coef), t_stat=either(t), sigma2=var,
                                           aic=np.where(known, information(n, fits.sse, size), np.nan), inverse=either(fits.inverse.reshape(len(n), -1)))

    return sums.mapInPandas(solve, f"{_schema(sums, keys)}, n bigint, coef array<double>, "
                                   "t_stat array<double>, sigma2 double, aic double, inverse array<double>")


def augmented_dickey_fuller(
    df: DataFrame, lags: int = 1, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """TSO9 with lagged changes in the regression."""
    w = ordered(key, order)
    rows = df.filter(q(value).isNotNull()).select(
        *[q(c) for c in names(key)], F.lag(q(value), 1).over(w).alias("level"),
        (q(value) - F.lag(q(value), 1).over(w)).alias("change"),
        *[(F.lag(q(value), i).over(w) - F.lag(q(value), i + 1).over(w)).alias(f"change_lag{i}")
          for i in range(1, lags + 1)])
    fit = least_squares(rows, ["level", *[f"change_lag{i}" for i in range(1, lags + 1)]], "change", key)
    return fit.select(*[q(c) for c in names(key)], "n", F.get("t_stat", F.lit(1)).alias("t_stat")).withColumn(
        "stationary", F.col("t_stat") < DF_CRITICAL_5PCT)


# --- linear trend (TSO10) -------------------------------------------------------

def trend_forecast(
    df: DataFrame, steps: int, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """TSO10: straight line through the filled series; under three points the last
    value, without any 0."""
    keys = names(key)
    filled = fill_both(df, keys, order, value)
    t = F.row_number().over(ordered(keys, order)) - 1
    rows = filled.select(*[q(c) for c in keys], q(order), q(value).alias("_v"), t.cast("double").alias("_t"))
    fit = rows.groupBy(*[q(c) for c in keys]).agg(
        F.max(q(order)).alias("_last"), F.count("_v").alias("_n"), F.max_by("_v", q(order)).alias("_tail"),
        F.regr_slope("_v", "_t").alias("_b"), F.regr_intercept("_v", "_t").alias("_a"), F.max("_t").alias("_end"))
    line = F.col("_a") + F.col("_b") * (F.col("_end") + F.col("step"))
    return (fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .select(*[q(c) for c in keys], F.add_months("_last", F.col("step")).alias(order), "step",
                    F.when(F.col("_n") < 3, F.coalesce("_tail", F.lit(0.0)))
                    .otherwise(F.coalesce(line, F.col("_tail"))).alias("forecast")))


# --- autoregression (TSO12, TSO14) ----------------------------------------------

@dataclass(frozen=True)
class LagModel:
    """Autoregression of the d-th difference on the given lags, with intercept."""
    d: int
    lags: tuple[int, ...]

    @property
    def name(self) -> str:
        return f"d{self.d}_lags" + ("_".join(map(str, self.lags)) or "0")


# Grid of the automatic search: p <= 3, d <= 2.
AUTO_GRID = [LagModel(d, tuple(range(1, p + 1))) for d in range(3) for p in range(4)]

# Seasonal model first, then the plainer ones it falls back to.
SEASONAL_ORDER = [
    LagModel(1, (1, 12)), LagModel(0, (1, 12)), LagModel(0, (1,)), LagModel(1, (1, 2)), LagModel(1, ()),
]


def _orders(models: Sequence[LagModel]) -> dict[int, list[int]]:
    """All lags used with each difference order."""
    return {d: sorted({k for m in models if m.d == d for k in m.lags}) for d in sorted({m.d for m in models})}


def lag_model_sums(
    df: DataFrame, models: Sequence[LagModel], exogenous: Sequence[str] = (), key: Names = KEY,
    order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """Per series one row: Gram sums per difference order over the same rows (so all fits
    compare), the last values, the last exogenous values and the last date. One window
    sort and one aggregation serve the whole grid: a model's sums are a part of those
    of its order. Values are scaled by the mean absolute value of their series."""
    keys = names(key)
    by = [q(c) for c in keys]
    w = ordered(keys, order)
    whole = Window.partitionBy(*by)
    orders = _orders(models)
    max_d, reach = max(orders), max((max(lags, default=0) for lags in orders.values()), default=0)
    scaled = fill_both(df, keys, order, value).select(
        *by, q(order), *[finite(q(c).cast("double")).alias(c) for c in exogenous],
        q(value).cast("double").alias("_raw"),
        F.coalesce(F.nullif(F.avg(F.abs(q(value))).over(whole), F.lit(0.0)), F.lit(1.0)).alias("_unit"))
    scaled = scaled.withColumn("_v", F.col("_raw") / F.col("_unit"))
    staged = difference_columns(scaled, max_d, keys, order, "_v")
    lagged = staged.select("*", *[F.lag(f"_d{d}", k).over(w).alias(f"_d{d}_{k}") for d, lags in orders.items() for k in lags],
                           F.row_number().over(w).alias("_t"), F.count(F.lit(1)).over(whole).alias("_rows"))
    complete = F.col("_t") > max_d + reach
    for c in exogenous:
        complete = complete & q(c).isNotNull()
    lagged = lagged.withColumn("_use", complete.cast("double"))
    aggs = []
    for d, lags in orders.items():
        design = [F.lit(1.0)] + [F.col(f"_d{d}_{k}") for k in lags] + [q(c) for c in exogenous]
        y = F.col(f"_d{d}")
        p = len(design)

        def total(c: Column) -> Column:
            return F.coalesce(F.sum(F.when(F.col("_use") == 1.0, c)), F.lit(0.0))

        aggs.append(F.struct(
            F.array(*[total(design[a] * design[b]) for a in range(p) for b in range(a, p)]).alias("xx"),
            F.array(*[total(design[a] * y) for a in range(p)]).alias("xy"), total(y * y).alias("yy")).alias(f"m{d}"))
    tail = F.when(F.col("_rows") - F.col("_t") <= max_d + reach, F.struct(q(order), F.col("_v")))
    return lagged.groupBy(*by).agg(
        F.sum("_use").cast("bigint").alias("n"), F.max(q(order)).alias("last_date"), F.max("_unit").alias("unit"),
        F.transform(F.array_sort(F.collect_list(tail)), lambda s: s["_v"]).alias("tail"),
        (F.max_by(F.array(*[q(c) for c in exogenous]), q(order)) if exogenous
         else F.array().cast("array<double>")).alias("exog_tail"),
        F.array(*aggs).alias("sums"))


def _paths(model: LagModel, coef: np.ndarray, tail: np.ndarray, exog: np.ndarray, steps: int) -> np.ndarray:
    """Recursive forecasts of the level, one row per series, from the last values and
    held exogenous ones."""
    diffs = [tail]
    for _ in range(model.d):
        diffs.append(np.diff(diffs[-1], axis=1))
    past = [diffs[-1][:, i] for i in range(diffs[-1].shape[1])]
    p = len(model.lags)
    fixed = coef[:, 0] + np.einsum("mi,mi->m", exog, coef[:, 1 + p:])
    for _ in range(steps):
        past.append(fixed + sum((coef[:, 1 + i] * past[-k] for i, k in enumerate(model.lags)), np.zeros(len(coef))))
    out = np.stack(past[-steps:], axis=1)
    for level in range(model.d - 1, -1, -1):
        out = diffs[level][:, -1:] + np.cumsum(out, axis=1)
    return out


def _spreads(model: LagModel, coef: np.ndarray, steps: int) -> np.ndarray:
    """Standard deviation multipliers of the h-step errors (psi weights), per series."""
    psi = np.zeros((len(coef), steps))
    psi[:, 0] = 1.0
    for h in range(1, steps):
        psi[:, h] = sum((coef[:, 1 + i] * psi[:, h - k] for i, k in enumerate(model.lags) if h >= k), np.zeros(len(coef)))
    for _ in range(model.d):
        psi = np.cumsum(psi, axis=1)
    return np.sqrt(np.cumsum(psi ** 2, axis=1))


def lag_model_forecast(
    df: DataFrame, steps: int, models: Sequence[LagModel] = tuple(AUTO_GRID), exogenous: Sequence[str] = (),
    pick: str = "aic", key: Names = KEY, order: str = ORDER, value: str = VALUE, flat_steps: int = 5,
) -> DataFrame:
    """TSO12 (`pick="aic"`): best model of the grid by AIC. TSO14 (`pick="first"`):
    first model in order that can be fitted and whose forecast is not flat over the first `flat_steps` steps; the last one is taken though flat. Rows are
    (key, date, step, model, forecast, lower, upper); exogenous values are held at
    their last level. Series too short for every model give their last value."""
    keys = names(key)
    sums = spread_rows(lag_model_sums(df, models, exogenous, keys, order, value), keys)
    orders = _orders(models)
    # Where each model's columns are in the sums of its order.
    places = [[0, *[1 + orders[m.d].index(k) for k in m.lags],
               *[1 + len(orders[m.d]) + i for i in range(len(exogenous))]] for m in models]
    sizes = {d: 1 + len(lags) + len(exogenous) for d, lags in orders.items()}
    keep = max(orders) + max(max(lags, default=0) for lags in orders.values()) + 1
    labels = np.array([*[m.name for m in models], "last_value"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            if m == 0:
                continue
            n = pdf["n"].to_numpy(dtype=float)
            unit = np.nan_to_num(pdf["unit"].to_numpy(dtype=float), nan=1.0)
            tail = np.full((m, keep), np.nan)
            for i, v in enumerate(pdf["tail"]):
                if len(v):
                    tail[i, -len(v):] = v
            exog = np.stack([np.asarray(v, dtype=float) for v in pdf["exog_tail"]]).reshape(m, len(exogenous))
            full = {}
            for at, d in enumerate(orders):
                parts = [v[at] for v in pdf["sums"]]
                full[d] = (full_matrices(np.stack([v["xx"] for v in parts]), sizes[d]),
                           np.stack([v["xy"] for v in parts]), np.array([v["yy"] for v in parts], dtype=float))
            # Without a usable model: the last value, no interval.
            path = np.repeat(np.nan_to_num(tail[:, -1:]), steps, axis=1)
            width = np.full((m, steps), np.nan)
            best, chosen = np.full(m, np.inf), np.full(m, len(models))
            for j, (model, at) in enumerate(zip(models, places)):
                p = len(at)
                xx, xy, yy = full[model.d]
                fits = solve_systems(xx[:, at][:, :, at], xy[:, at], yy)
                with np.errstate(all="ignore"):
                    tried = _paths(model, fits.coef, tail, exog, steps)
                    aic = information(n, fits.sse, p)
                    usable = (n > p + 1) & np.isfinite(tried).all(axis=1)
                    if pick == "first":
                        if steps > 1 and j < len(models) - 1:
                            usable &= np.std(tried[:, :flat_steps], axis=1) * unit >= 1e-8
                        better = usable & (chosen == len(models))
                    else:
                        better = usable & (aic < best)
                    sd = np.sqrt(fits.sse / (n - p))[:, None] * _spreads(model, fits.coef, steps)
                best, chosen = np.where(better, aic, best), np.where(better, j, chosen)
                path, width = np.where(better[:, None], tried, path), np.where(better[:, None], sd, width)
            level, half = path * unit[:, None], Z95 * width * unit[:, None]
            out = pdf[[*keys, "last_date"]].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            yield out.assign(
                step=np.tile(np.arange(1, steps + 1, dtype=np.int32), m), model=np.repeat(labels[chosen], steps),
                aic=np.repeat(np.where(chosen < len(models), best, np.nan), steps), forecast=level.ravel(),
                lower=(level - half).ravel(), upper=(level + half).ravel())

    out = sums.mapInPandas(run, f"{_schema(sums, [*keys, 'last_date'])}, step int, model string, aic double, "
                                "forecast double, lower double, upper double")
    return out.select(*[q(c) for c in keys], F.add_months("last_date", F.col("step")).alias(order), "step", "model",
                      "aic", "forecast", "lower", "upper")


def ar1_forecast(
    df: DataFrame, steps: int, key: Names = KEY, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """TSO12 for one lag, wholly in the JVM: regr_* fit and closed-form recursion. Null where the fit is undefined
    (fewer than two pairs, or a constant series)."""
    keys = names(key)
    w = ordered(keys, order)
    rows = df.filter(q(value).isNotNull()).select(
        *[q(c) for c in keys], q(order), q(value).alias("_y"), F.lag(q(value), 1).over(w).alias("_x"))
    fit = rows.groupBy(*[q(c) for c in keys]).agg(
        F.max(q(order)).alias("_last"), F.max_by("_y", q(order)).alias("_tail"),
        F.regr_slope("_y", "_x").alias("phi"), F.regr_intercept("_y", "_x").alias("c"))
    h = F.col("step").cast("double")
    power = F.pow("phi", h)
    total = F.when(F.col("phi") == 1, h).otherwise(F.try_divide(1.0 - power, 1.0 - F.col("phi")))
    return (fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .select(*[q(c) for c in keys], F.add_months("_last", F.col("step")).alias(order), "step",
                    (F.col("c") * total + power * F.col("_tail")).alias("forecast")))


# --- regression on trend, season and regressors (TSO13) --------------------------

def seasonal_design(start: Column, date: Column, pairs: int = 6) -> dict[str, Column]:
    """Trend in years and yearly sin/cos pairs of a date."""
    t = F.datediff(date, start) / F.lit(365.25)
    cols = {"trend_years": t}
    for k in range(1, pairs + 1):
        angle = F.lit(2 * math.pi * k) * t
        cols[f"year_sin_{k}"], cols[f"year_cos_{k}"] = F.sin(angle), F.cos(angle)
    return cols


def fit_seasonal_regression(
    df: DataFrame, regressors: Sequence[str] = (), pairs: int = 3, key: Names = KEY, order: str = ORDER,
    value: str = VALUE,
) -> DataFrame:
    """TSO13, fit: one row per series with start date, coefficients (intercept, trend, season,
    regressors), residual variance and the inverse of X'X."""
    keys = names(key)
    starts = df.groupBy(*[q(c) for c in keys]).agg(F.min(q(order)).alias("start"))
    rows = df.join(starts, keys)
    design = seasonal_design(F.col("start"), q(order), pairs)
    rows = rows.select(*[q(c) for c in keys], "start", q(value).alias("_y"),
                       *[c.alias(n) for n, c in design.items()], *[q(r) for r in regressors])
    return least_squares(rows, [*design, *regressors], "_y", [*keys, "start"], minimum_norm=True).select(
        *[q(c) for c in keys], "start", "coef", "sigma2", "inverse")


def predict_seasonal_regression(
    future: DataFrame, fit: DataFrame, regressors: Sequence[str] = (), pairs: int = 3, key: Names = KEY,
    order: str = ORDER,
) -> DataFrame:
    """TSO13, predict: dot product of coefficients and design, in the JVM, with the 95 % interval of a new
    value (residual variance and the coefficients' own); the interval is null for a fit without residual degrees of freedom."""
    rows = future.join(fit, names(key))
    design = [F.lit(1.0), *seasonal_design(F.col("start"), q(order), pairs).values(),
              *[F.coalesce(q(r).cast("double"), F.lit(0.0)) for r in regressors]]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_x", F.array(*design))
    outer = F.flatten(F.transform("_x", lambda a: F.transform("_x", lambda b: a * b)))
    rows = rows.withColumns({"forecast": total(F.zip_with("coef", "_x", lambda a, b: a * b)),
                             "_own": total(F.zip_with("inverse", outer, lambda a, b: a * b))})
    half = Z95 * F.sqrt(F.col("sigma2") * (1.0 + F.greatest("_own", F.lit(0.0))))
    return (rows.withColumns({"lower": F.col("forecast") - half, "upper": F.col("forecast") + half})
            .drop("start", "coef", "sigma2", "inverse", "_x", "_own"))


def seasonal_regression_forecast(
    df: DataFrame, steps: int, regressors: Sequence[str] = (), future_regressors: DataFrame | None = None,
    pairs: int = 3, key: Names = KEY, order: str = ORDER, value: str = VALUE,
    forecast_key: Names | None = None,
) -> DataFrame:
    """TSO13: fit on history, forecast `steps` months. Regressors come from
    `future_regressors` where it has them and else keep their last value."""
    keys = names(key)
    filled = fill_columns(df, regressors, keys, order) if regressors else df
    fit = fit_seasonal_regression(filled, regressors, pairs, keys, order, value)
    future = future_exogenous(filled.select(*[q(c) for c in [*keys, order, *regressors]]), steps, regressors,
                              future_regressors, keys, order, forecast_key)
    return predict_seasonal_regression(future, fit, regressors, pairs, keys, order).select(
        *[q(c) for c in keys], q(order), "step", "forecast", "lower", "upper")


def future_exogenous(
    history: DataFrame, steps: int, columns: Sequence[str], forecasts: DataFrame | None = None,
    key: Names = KEY, order: str = ORDER, forecast_key: Names | None = None,
) -> DataFrame:
    """TSO16: regressors of the future months: their forecast if there is one, else the
    last known value, else 0. Always exactly `steps` rows per series. `forecast_key`
    is the part of the key that the forecasts carry (all of it by default)."""
    keys = names(key)
    shared = names(forecast_key) if forecast_key is not None else keys
    held = repeat_last(fill_columns(history, columns, keys, order), steps, keys, order)
    if forecasts is None:
        return held.select(*[q(c) for c in [*keys, order]], "step",
                           *[F.coalesce(q(c), F.lit(0.0)).alias(c) for c in columns])
    known = [c for c in columns if c in forecasts.columns]
    ahead = forecasts.select(*[q(c) for c in shared], q(order), *[q(c).alias(f"_f_{c}") for c in known])
    joined = held.join(ahead, [*shared, order], "left")
    return joined.select(*[q(c) for c in [*keys, order]], "step", *[
        F.coalesce(*([F.col(f"`_f_{c}`")] if c in known else []), q(c), F.lit(0.0)).alias(c) for c in columns])


def fill_columns(df: DataFrame, columns: Sequence[str], key: Names = KEY, order: str = ORDER) -> DataFrame:
    """Forward then backward fill of several columns in one select."""
    w, back = upto(ordered(key, order)), back_from_end(key, order)
    return df.withColumns({c: F.coalesce(F.last(q(c), True).over(w), F.last(q(c), True).over(back)) for c in columns})


# --- vector autoregression (TSO15) -----------------------------------------------

def vector_forecast(
    df: DataFrame, series: Sequence[str], steps: int, p: int = 1, d: Mapping[str, int] | int = 0,
    key: Names = KEY, order: str = ORDER,
) -> DataFrame:
    """TSO15: vector autoregression of order p over the given panel columns, one model
    per key, all equations sharing X'X. Columns with d = 1 are differenced first and
    their forecasts integrated. Rows are (key, date, step, one column per series)."""
    keys = names(key)
    orders = {c: (d if isinstance(d, int) else d.get(c, 0)) for c in series}
    if any(v not in (0, 1) for v in orders.values()):
        raise ValueError("difference order must be 0 or 1")
    by = [q(c) for c in keys]
    w = ordered(keys, order)
    whole = Window.partitionBy(*by)
    filled = fill_columns(df.select(*by, q(order), *[q(c).cast("double").alias(c) for c in series]), series, keys, order)
    unit = filled.withColumns({f"_u_{c}": F.coalesce(F.nullif(F.avg(F.abs(q(c))).over(whole), F.lit(0.0)), F.lit(1.0))
                               for c in series})
    work = unit.withColumns({f"_s_{c}": q(c) / F.col(f"`_u_{c}`") for c in series})
    work = work.withColumns({f"_w_{c}": (F.col(f"`_s_{c}`") - F.lag(F.col(f"`_s_{c}`"), 1).over(w)) if orders[c]
                             else F.col(f"`_s_{c}`") for c in series})
    lag_names = [f"_l{k}_{c}" for k in range(1, p + 1) for c in series]
    work = work.withColumns({f"_l{k}_{c}": F.lag(F.col(f"`_w_{c}`"), k).over(w) for k in range(1, p + 1) for c in series})
    sums = wide_gram(work, lag_names, [f"_w_{c}" for c in series], keys)
    back = work.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(q(order).desc())))
    tail = F.when(F.col("_back") <= p, F.struct(q(order), F.array(*[F.col(f"`_w_{c}`") for c in series]).alias("v")))
    tails = back.groupBy(*by).agg(
        F.max(q(order)).alias("last_date"),
        F.transform(F.array_sort(F.collect_list(tail)), lambda s: s["v"]).alias("tail"),
        F.max_by(F.array(*[F.col(f"`_s_{c}`") for c in series]), q(order)).alias("level"),
        F.array(*[F.max(F.col(f"`_u_{c}`")) for c in series]).alias("unit"))
    ready = spread_rows(tails.join(sums, keys, "left"), keys)
    order_vec = np.array([orders[c] for c in series])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, k, size = len(pdf), len(series), 1 + p * len(series)
            if not m:
                continue
            level, units = (np.stack(pdf[c].to_list()).astype(float) for c in ("level", "unit"))
            path = np.repeat(level[:, None, :], steps, axis=1)
            fit = np.flatnonzero(pdf["xx"].notna().to_numpy() & (pdf["n"].fillna(0).to_numpy() > size))
            if len(fit):  # all keys of the batch step on together
                some = pdf.iloc[fit]
                right = np.stack([np.stack(list(v)) for v in some["xy"]])
                # The equations of a key share X'X, which is inverted once.
                left = solve_systems(full_matrices(np.stack(some["xx"].to_list()), size), right[:, 0], np.stack(some["yy"].to_list()).astype(float)[:, 0])
                coef = np.stack([np.einsum("mij,mj->mi", left.inverse, np.ascontiguousarray(right[:, e])) for e in range(k)], axis=1)
                past = list(np.stack([np.stack(list(v)) for v in some["tail"]]).astype(float).transpose(1, 0, 2))
                at = level[fit]
                for h in range(steps):
                    x = np.concatenate([np.ones((len(fit), 1)), *[past[-i] for i in range(1, p + 1)]], axis=1)
                    past.append(np.einsum("mks,ms->mk", coef, x))
                    at = np.where(order_vec == 1, at + past[-1], past[-1])
                    path[fit, h] = at
            flat = (path * units[:, None, :]).reshape(m * steps, k)
            out = pdf[[*keys, "last_date"]].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            out["step"] = np.tile(np.arange(1, steps + 1, dtype=np.int32), m)
            yield out.assign(**{c: flat[:, i] for i, c in enumerate(series)})

    out = ready.mapInPandas(run, f"{_schema(ready, [*keys, 'last_date'])}, step int, "
                            + ", ".join(f"`{c}` double" for c in series))
    return out.select(*by, F.add_months("last_date", F.col("step")).alias(order), "step", *[q(c) for c in series])


# --- walk-forward evaluation (TSO19) ---------------------------------------------

def walk_forward(
    df: DataFrame, split: str, lags: Sequence[int] = (1, 2, 3), key: Names = KEY, order: str = ORDER,
    value: str = VALUE,
) -> DataFrame:
    """TSO19: coefficients from rows before the split, one-step forecasts for the rows
    after it, each from the true values before it (train tail included). A forecast is null where a value
    before it is missing or the series has fewer complete training rows than coefficients."""
    keys = names(key)
    w = ordered(keys, order)
    cols = [f"lag{k}" for k in lags]
    rows = df.select(*[q(c) for c in keys], q(order), q(value).alias("actual"),
                     *[F.lag(q(value), k).over(w).alias(c) for k, c in zip(lags, cols)])
    edge = F.lit(split).cast("date")
    fit = least_squares(rows.filter(q(order) < edge), cols, "actual", keys)
    scored = rows.filter(q(order) >= edge).join(fit.select(*[q(c) for c in keys], "coef"), keys, "left")
    dot = F.aggregate(F.zip_with("coef", F.array(F.lit(1.0), *[q(c) for c in cols]), lambda a, b: a * b),
                      F.lit(0.0), lambda a, x: a + x)
    return scored.select(*[q(c) for c in keys], q(order), "actual", dot.alias("forecast"))
