"""Scaling, folds and meta-features (MLO1, MLO6, MLO8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.columns import Names, names, q
from macrospark.constants import BASE_WEIGHTS
from macrospark.operators.blocks import row_index
from macrospark.operators.quantiles import exact_quantiles

Scale = Mapping[str, tuple[float, float]]


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Scale:
    """MLO1: mean and population std per column, from one pass. Scales under 1e-6
    become 1. Two numbers per column reach the driver."""
    row = df.agg(*[F.avg(q(c)).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(q(c)).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, _safe(row[f"s_{c}"])) for c in columns}


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Scale:
    """MLO1: exact median and interquartile range per column. No column is held in one task."""
    long = df.select(*[q(c).cast("double").alias(c) for c in columns]).unpivot(
        [], [q(c) for c in columns], "column", "value")
    found = {r["column"]: r for r in exact_quantiles(long, "value", [0.25, 0.5, 0.75], "column").collect()}
    return {c: (found[c]["q1"], _safe(found[c]["q2"] - found[c]["q0"])) if c in found else (0.0, 1.0)
            for c in columns}


def _safe(scale: float | None) -> float:
    return 1.0 if scale is None or scale < 1e-6 else float(scale)


def apply_scale(df: DataFrame, scale: Scale) -> DataFrame:
    """MLO1: (x - centre) / scale with the fitted numbers as literals."""
    return df.withColumns({c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def assign_folds(
    df: DataFrame, k: int, ids: Names, stratum: str | None = None, seed: int = 42, output: str = "fold"
) -> DataFrame:
    """MLO6: shuffled folds of equal size (to one row) inside each stratum. Rows are
    numbered in the order of a hash of their id, in even ranges of it, twice as many as the session
    has shuffle partitions, so no stratum has to pass through one task."""
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws("|", F.lit(str(seed)), *[q(c).cast("string") for c in names(ids)])
    hashed = (df.withColumn("_h", F.md5(text)).withColumn("_block", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") * ranges / 2.0 ** 32))
              .withColumn("_stratum", F.coalesce(q(stratum).cast("string"), F.lit("")) if stratum else F.lit("")))
    return (row_index(hashed, ["_h", *names(ids)], "_stratum", "_block", output)
            .withColumn(output, (F.col(output) % k).cast("int")).drop("_h", "_block", "_stratum"))


META_SUFFIXES = ["mean", "weighted", "std", "min", "max"]


def meta_features(bases: Sequence[Column], weights: Sequence[float] = tuple(BASE_WEIGHTS)) -> dict[str, Column]:
    """MLO8: the base predictions, their mean, fixed-weight mean, population std,
    minimum, maximum, and every pairwise absolute difference."""
    n = len(bases)
    mean = sum(bases[1:], bases[0]) / n
    squares = [(b - mean) * (b - mean) for b in bases]
    weighted = [w * b for w, b in zip(weights, bases)]
    out = {f"base_{i}": b for i, b in enumerate(bases)}
    out["mean"] = mean
    out["weighted"] = sum(weighted[1:], weighted[0])
    out["std"] = F.sqrt(sum(squares[1:], squares[0]) / n)
    out["min"], out["max"] = F.least(*bases), F.greatest(*bases)
    for i, j in combinations(range(n), 2):
        out[f"diff_{i}_{j}"] = F.abs(bases[i] - bases[j])
    return out


def tail_cutoff(df: DataFrame, order: str, fraction: float) -> int:
    """Day number after which about `fraction` of the rows lie: one exact quantile."""
    days = df.select(F.unix_date(q(order)).alias("_day"))
    return int(exact_quantiles(days, "_day", [1.0 - fraction]).first()["q0"])


def tail_flag(df: DataFrame, order: str, fraction: float, output: str = "is_validation") -> DataFrame:
    """Marks the newest rows, for early stopping and ordered evaluation."""
    return df.withColumn(output, F.unix_date(q(order)) > F.lit(tail_cutoff(df, order, fraction)))
