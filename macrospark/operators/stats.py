"""Aggregations and metrics (AGG1-AGG24, TOP4, TOP5). Unless noted, each is one
combinable aggregation, so a hot group is folded before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.columns import KEY, ORDER, VALUE, Names, names, numeric_columns, q
from macrospark.operators.quantiles import exact_quantiles


def keyed(df: DataFrame, key: Names):
    return df.groupBy(*[q(c) for c in names(key)])


def monthly_mean(df: DataFrame, key: Names = KEY, order: str = ORDER, value: str = VALUE) -> DataFrame:
    """AGG1: mean per calendar month, dated by its first day; nulls skipped."""
    return df.groupBy(*[q(c) for c in names(key)], F.trunc(q(order), "month").alias(order)).agg(
        F.avg(q(value)).alias(value))


def calendar_means(df: DataFrame, order: str = ORDER, value: str = VALUE) -> DataFrame:
    """AGG2: mean by quarter and by month name with their calendar position."""
    part = F.explode(F.array(
        F.struct(F.lit("quarter").alias("grain"), F.quarter(q(order)).alias("position"),
                 F.concat(F.lit("Q"), F.quarter(q(order))).alias("label")),
        F.struct(F.lit("month").alias("grain"), F.month(q(order)).alias("position"),
                 F.date_format(q(order), "MMMM").alias("label"))))
    return (df.select(part.alias("p"), q(value).alias("_v")).groupBy("p.grain", "p.position", "p.label")
            .agg(F.avg("_v").alias("mean")).orderBy("grain", "position"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG3 / AGG6: one row per numeric column; one pass over the table."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    one = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.count(q(c)).alias("count"), F.min(q(c)).cast("double").alias("min"),
        F.max(q(c)).cast("double").alias("max"), F.avg(q(c)).alias("mean"), F.stddev_samp(q(c)).alias("std"),
        F.count_if(q(c).isNull()).alias("nulls"),
        (F.avg(q(c).isNull().cast("int")) * 100.0).alias("null_pct")).alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cols))])))


def distinct_ratio(df: DataFrame, key: Names, value: str, exact: bool = True) -> DataFrame:
    """AGG4: distinct values and their share of the rows. `exact=False` uses a
    fixed-size sketch."""
    distinct = F.count_distinct(q(value)) if exact else F.approx_count_distinct(q(value))
    return keyed(df, key).agg(distinct.alias("n_unique"), F.count(F.lit(1)).alias("n")).withColumn(
        "unique_ratio", F.col("n_unique") / F.col("n"))


def missing_share(df: DataFrame, key: Names = KEY, value: str = VALUE) -> DataFrame:
    """AGG6, long form."""
    return keyed(df, key).agg(F.count_if(q(value).isNull()).alias("missing"),
                              (F.avg(q(value).isNull().cast("int")) * 100.0).alias("missing_pct"))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG7: absolute Pearson correlation of every pair of panel columns, upper
    triangle, from one aggregation over the rows (no self-join). Rows where either
    side is null are left out of that pair."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
                            F.abs(F.corr(q(a), q(b))).alias("correlation")).alias(f"_{i}")
                   for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(pairs))])))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG7 as a full matrix in long form."""
    upper = pair_correlations(df, columns)
    flipped = upper.select(F.col("right").alias("left"), F.col("left").alias("right"), "correlation")
    same = df.agg(*[F.max(F.when(q(c).isNotNull(), 1.0)).alias(c) for c in columns]).unpivot(
        [], [q(c) for c in columns], "left", "correlation")
    return upper.unionByName(flipped).unionByName(same.select("left", F.col("left").alias("right"), "correlation"))


def high_correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """AGG8: pairs above the threshold, strongest first."""
    return (pair_correlations(df, columns).filter(F.col("correlation") > threshold)
            .orderBy(F.desc("correlation"), "left", "right"))


def correlation_ranking(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int | None = None
) -> DataFrame:
    """AGG9: sum over the targets of absolute correlations (0 where undefined)."""
    one = df.agg(*[F.struct(
        F.lit(f).alias("feature"),
        sum((F.coalesce(F.abs(F.corr(q(f), q(t))), F.lit(0.0)) for t in targets[1:]),
            F.coalesce(F.abs(F.corr(q(f), q(targets[0]))), F.lit(0.0))).alias("score")).alias(f"_{i}")
        for i, f in enumerate(features)])
    long = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    return top_features(long, k or len(features))


def top_features(scores: DataFrame, k: int, feature: str = "feature", score: str = "score") -> DataFrame:
    """TOP4: k best, ties by name."""
    return scores.orderBy(q(score).desc(), q(feature)).limit(k)


def quartile_bins(df: DataFrame, value: str, output: str = "bin") -> DataFrame:
    """AGG10: 0-3 by quartile edges; the maximum falls in bin 4 of its own."""
    edges = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    # One row of five numbers: a scalar, read once and put in the plan as literals.
    row = edges.first()
    v = q(value)
    count = sum((F.when(v >= row[f"q{i}"], 1).otherwise(0) for i in range(1, 5)),
                F.when(v >= row["q0"], 1).otherwise(0))
    return df.withColumn(output, F.when(v.isNotNull(), count - 1))


def fit_line(df: DataFrame, key: Names, x: str, y: str) -> DataFrame:
    """AGG11."""
    return keyed(df, key).agg(F.regr_slope(q(y), q(x)).alias("slope"),
                              F.regr_intercept(q(y), q(x)).alias("intercept"),
                              F.regr_r2(q(y), q(x)).alias("r2"))


# --- forecast metrics ---------------------------------------------------------

ACTUAL, FORECAST = "actual", "forecast"


def mae(y: Column, p: Column) -> Column:
    """AGG12."""
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    """AGG12."""
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column, variant: str = "skip_zero") -> Column:
    """AGG13. skip_zero: zero actuals leave the numerator and the count;
    null_zero: |e| / y with null for zero; floor: divide by max(|y|, 1e-8);
    at_least_one: divide by max(y, 1)."""
    e = F.abs(y - p)
    if variant == "skip_zero":
        share = F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))
    elif variant == "null_zero":
        share = F.abs((y - p) / F.nullif(y, F.lit(0.0)))
    elif variant == "floor":
        share = e / F.greatest(F.abs(y), F.lit(1e-8))
    elif variant == "at_least_one":
        share = F.abs((y - p) / F.greatest(y, F.lit(1.0)))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return F.avg(share) * 100.0


def r2(y: Column, p: Column) -> Column:
    """AGG14, from centred moments."""
    e = y - p
    both = F.when(e.isNotNull(), y)
    return 1.0 - F.try_divide(F.sum(e * e), F.var_pop(both) * F.count(e))


def forecast_metrics(
    df: DataFrame, key: Names, actual: str = ACTUAL, forecast: str = FORECAST, variant: str = "at_least_one"
) -> DataFrame:
    """AGG12-AGG14 per group."""
    y, p = q(actual), q(forecast)
    return keyed(df, key).agg(
        mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), r2(y, p).alias("r2"),
        mape(y, p, variant).alias("mape"), F.max(F.abs(y - p)).alias("max_error"),
        F.stddev_samp(y - p).alias("residual_std"))


def metric_means(metrics: DataFrame, key: Names = ()) -> DataFrame:
    """AGG14: averages over the targets."""
    cols = ["mae", "rmse", "r2", "mape"]
    return keyed(metrics, key).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def metric_table(
    metrics: DataFrame, architectures: Sequence[str], target: str = "target", arch: str = "architecture",
    columns: Sequence[str] = ("mae", "rmse", "r2"), digits: int = 4,
) -> DataFrame:
    """AGG15: target rows, one column per metric and architecture."""
    return metrics.groupBy(q(target)).agg(*[
        F.round(F.avg(F.when(q(arch) == a, q(m))), digits).alias(f"{m}_{a}")
        for m in columns for a in architectures])


def compare_models(
    metrics: DataFrame, first: str, second: str, target: str = "target", arch: str = "architecture"
) -> DataFrame:
    """AGG16: per target both errors, improvement of the second over the first in
    percent for MAE and R2, and the winner (ties go to the first for the winner name)."""
    def of(a: str, m: str) -> Column:
        return F.max(F.when(q(arch) == a, q(m)))

    both = metrics.groupBy(q(target)).agg(
        of(first, "mae").alias("mae_first"), of(second, "mae").alias("mae_second"),
        of(first, "r2").alias("r2_first"), of(second, "r2").alias("r2_second"))
    return both.withColumns({
        "mae_improvement": F.try_divide(F.col("mae_first") - F.col("mae_second"), F.col("mae_first")) * 100.0,
        "r2_improvement": (F.col("r2_second") - F.col("r2_first"))
        / F.greatest(F.abs("r2_first"), F.lit(0.001)) * 100.0,
        "winner": F.when(F.col("mae_second") < F.col("mae_first"), second).otherwise(first)})


def model_summary(
    metrics: DataFrame, target: str = "target", arch: str = "architecture"
) -> DataFrame:
    """AGG16: mean metrics and number of targets won (lowest MAE) per architecture."""
    wins = (metrics.groupBy(q(target)).agg(F.min_by(q(arch), F.struct("mae", q(arch))).alias(arch))
            .groupBy(arch).agg(F.count(F.lit(1)).alias("wins")))
    means = metrics.groupBy(q(arch)).agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "r2")])
    return means.join(wins, arch, "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def leaderboard(metrics: DataFrame, by: str = "rmse", key: Names = KEY) -> DataFrame:
    """AGG17."""
    return metrics.orderBy(q(by), *[q(c) for c in names(key)])


def flag_counts(df: DataFrame, flags: Sequence[str], split: Column, key: Names = ()) -> DataFrame:
    """AGG19: flagged rows per split."""
    return df.groupBy(*[q(c) for c in names(key)], split.alias("split")).agg(
        *[F.sum(q(f).cast("long")).alias(f) for f in flags])


def feature_votes(selected: DataFrame, k: int = 40, feature: str = "feature") -> DataFrame:
    """AGG20: in how many target selections each feature is; the k most frequent."""
    return (selected.groupBy(q(feature)).agg(F.count(F.lit(1)).alias("votes"))
            .orderBy(F.desc("votes"), q(feature)).limit(k))


def rank_scores(
    rankings: DataFrame, feature: str = "feature", rank: str = "rank", selected: str = "selected"
) -> DataFrame:
    """AGG21: 0.7 * mean(1 / rank) + 0.3 * share of targets that selected the feature."""
    return (rankings.groupBy(q(feature))
            .agg(F.avg(1.0 / q(rank)).alias("avg_importance"),
                 F.avg(q(selected).cast("double")).alias("selection_frequency"))
            .withColumn("combined_score", 0.7 * F.col("avg_importance") + 0.3 * F.col("selection_frequency")))


def coverage(df: DataFrame, now: Column, key: Names = KEY, order: str = ORDER) -> DataFrame:
    """AGG22: date span, age of the last row in days, and rows / (years * 12) in
    percent, with years counted as last year minus first year."""
    return (keyed(df, key).agg(F.min(q(order)).alias("first"), F.max(q(order)).alias("last"),
                               F.count(F.lit(1)).alias("n_rows"))
            .withColumn("days_old", F.datediff(now, F.col("last")))
            .withColumn("completeness", F.try_divide(
                F.col("n_rows") * 100.0, (F.year("last") - F.year("first")) * 12.0)))


def forecast_diagnostics(
    df: DataFrame, key: Names = KEY, actual: str = ACTUAL, forecast: str = FORECAST
) -> DataFrame:
    """AGG23: spread of the forecast, its ratio to that of the actuals (population
    std), and whether the forecast is flat (std < 1e-6) or weak (ratio < 1 %)."""
    p = q(forecast)
    return (keyed(df, key).agg(
        F.stddev_pop(p).alias("forecast_std"), (F.max(p) - F.min(p)).alias("forecast_range"),
        F.stddev_pop(q(actual)).alias("actual_std"),
        (F.try_divide(F.stddev_samp(p), F.abs(F.avg(p))) * 100.0).alias("cv_pct"))
        .withColumn("std_ratio", F.try_divide(F.col("forecast_std"), F.col("actual_std")))
        .withColumn("verdict", F.when(F.col("forecast_std") < 1e-6, "flat")
                    .when(F.col("std_ratio") < 0.01, "weak").otherwise("varied")))


# Feature-name endings by family. Fixed values.
FAMILIES = {
    "trend": "_trend", "seasonal": "_seasonal", "residual": "_residual", "anomaly": "_anomaly",
    "acf": "acf", "lag": "_lag", "rolling": "_roll", "difference": "_diff", "change": "_pct_change",
}


def family(feature: str) -> str:
    """First family whose mark is in the name; `base` for the others."""
    return next((f for f, mark in FAMILIES.items() if mark in feature), "base")


def family_counts(df: DataFrame) -> DataFrame:
    """AGG24: per feature family the number of columns and of values they hold."""
    counts = df.agg(*[F.count(q(c)).alias(c) for c in df.columns]).unpivot(
        [], [q(c) for c in df.columns], "feature", "values")
    label = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(family(c)))])
    return (counts.groupBy(label[F.col("feature")].alias("family"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("values").alias("values")))


def best_config(
    df: DataFrame, metric: str, key: Names = KEY, highest: bool = False, ties: Iterable[str] = ()
) -> DataFrame:
    """TOP5: the row with the best metric per series, ties by the given columns."""
    keys = names(key)
    rest = [c for c in df.columns if c not in keys]
    score = -q(metric) if highest else q(metric)
    pick = F.min_by(F.struct(*[q(c) for c in rest]),
                    F.when(q(metric).isNotNull(), F.struct(score.alias("s"), *[q(t) for t in ties])))
    best = keyed(df, keys).agg(pick.alias("_row"))
    return best.select(*[q(c) for c in keys], *[F.col("_row")[c].alias(c) for c in rest])


