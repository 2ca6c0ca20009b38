"""Walk-forward evaluation with a refit at each step (TSO19): the sums of products of all earlier rows run along each series, and every row has its own small
system, solved in Arrow batches. Nothing is fitted twice from the rows, so a series of n rows costs n running sums and not n passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, finite, names, ordered, q, spread
from macrospark.operators.forecast import _schema, full_matrices, solve_systems

#: Smallest eigenvalue, in units of the largest, of a system that its rows determine.
DETERMINED = 1e-12


def walk_forward_refit(
    df: DataFrame, split: str, lags: Sequence[int] = (1, 2, 3), within: int | None = None, key: Names = KEY, order: str = ORDER, value: str = VALUE,
) -> DataFrame:
    """One-step forecasts for the rows from `split` on, each by an autoregression fitted on all rows before it, or on the `within` rows before it. Rows are (key, date, actual, forecast, n), n being
    the complete rows of the fit; the forecast is null where they do not determine the coefficients, or a value that it needs is missing.

    Values are centred and scaled by series before they are multiplied, for the arithmetic only: a regression with intercept does not depend on either."""
    keys = names(key)
    by, w, whole = [q(c) for c in keys], ordered(keys, order), Window.partitionBy(*[q(c) for c in keys])
    p = 1 + len(lags)
    earlier = w.rowsBetween(Window.unboundedPreceding if within is None else -within, -1)
    unit = F.coalesce(F.nullif(F.stddev_pop("_v").over(whole), F.lit(0.0)), F.lit(1.0))
    rows = spread(df.select(*by, q(order), finite(q(value).cast("double")).alias("_v")), keys).select(
        *by, q(order), F.col("_v").alias("actual"), F.avg("_v").over(whole).alias("_mid"), unit.alias("_unit"))
    rows = rows.withColumn("_y", (F.col("actual") - F.col("_mid")) / F.col("_unit"))
    rows = rows.withColumns({f"_x{i}": F.lag("_y", k).over(w) for i, k in enumerate(lags, 1)})
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, p)]]
    known = F.lit(True)
    for c in x[1:]:
        known = known & c.isNotNull()
    full = known & F.col("_y").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(full, c)).over(earlier), F.lit(0.0))
    sums = rows.select(
        *by, q(order), "actual", "_mid", "_unit", F.when(known, F.array(*x)).alias("_x"), F.count(F.when(full, 1)).over(earlier).alias("n"),
        F.array(*[total(x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("_xx"),
        F.array(*[total(c * F.col("_y")) for c in x]).alias("_xy")).filter(q(order) >= F.lit(split).cast("date"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forecast = np.full(len(pdf), np.nan)
            at = np.flatnonzero(pdf["_x"].notna().to_numpy() & (pdf["n"].to_numpy() >= p))
            if len(at):
                some = pdf.iloc[at]
                xx, xy = full_matrices(np.stack(some["_xx"].to_list()), p), np.stack(some["_xy"].to_list())
                scale = np.sqrt(np.maximum(np.einsum("mii->mi", xx), 1e-300))
                values = np.linalg.eigvalsh(xx / scale[:, :, None] / scale[:, None, :])
                coef = solve_systems(xx, xy, np.zeros(len(at))).coef
                ahead = np.einsum("mi,mi->m", coef, np.stack(some["_x"].to_list())) * some["_unit"].to_numpy() + some["_mid"].to_numpy()
                forecast[at] = np.where(values[:, 0] > DETERMINED * values[:, -1], ahead, np.nan)
            yield pdf[[*keys, order, "actual", "n"]].assign(forecast=forecast)

    out = sums.mapInPandas(solve, f"{_schema(sums, [*keys, order, 'actual', 'n'])}, forecast double")
    return out.select(*by, q(order), F.when(~F.isnan("actual"), F.col("actual")).alias("actual"), F.when(~F.isnan("forecast"), F.col("forecast")).alias("forecast"), "n")
