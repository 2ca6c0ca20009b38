"""Queries for aggregations, metrics and data-quality rules."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.constants import INDICATORS, TARGETS
from macrospark.operators import clean as C, quality as DQ, stats as A, windows as W
from macrospark.operators.blocks import rank_in_order
from macrospark.operators.quantiles import medians, series_medians
from macrospark.operators.wide import wide_correlations
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import (
    ECONOMY, MEMBERS, PANEL, PART_OBS, SPLIT, dirty, economy, economy_targets, panel, part_obs, table,
)
from macrospark.plans.pipelines import all_panel_features, panel_features

Spark = SparkSession
WIN = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"


@query("agg1_monthly_mean", f"""SELECT l_partkey AS series_id, {d("date_trunc('month', l_shipdate)")}, {r('avg(l_extendedprice)', 'value')}
 FROM lineitem GROUP BY 1, 2""")
def _monthly(spark: Spark, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(q("l_partkey").alias("series_id"), q("l_shipdate").alias("date"),
                                                q("l_extendedprice").alias("value"))
    return A.monthly_mean(lines)


@query("agg2_calendar_means", """SELECT 'quarter' AS grain, CAST(quarter(o_orderdate) AS BIGINT) AS position, 'Q' || quarter(o_orderdate) AS label,
 round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1, 2, 3 UNION ALL SELECT 'month', CAST(month(o_orderdate) AS BIGINT), monthname(o_orderdate),
 round(avg(o_totalprice), 3) FROM orders GROUP BY 1, 2, 3""", 3)
def _calendar(spark: Spark, sf: str) -> DataFrame:
    return A.calendar_means(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg3_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')},
 {r(f'stddev_samp({c})', 'std')}, count(*) - count({c}) AS nulls, {r(f'avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END)', 'null_pct')} FROM lineitem"""
    for c in _PROFILED))
def _profile(spark: Spark, sf: str) -> DataFrame:
    return A.profile(table(spark, sf, "lineitem"), _PROFILED)


@query("agg4_distinct_ratio", f"""SELECT l_returnflag AS series_id, count(DISTINCT l_partkey) AS n_unique, count(*) AS n,
 {r('count(DISTINCT l_partkey)::DOUBLE / count(*)', 'unique_ratio')} FROM lineitem GROUP BY 1""")
def _distinct(spark: Spark, sf: str) -> DataFrame:
    return A.distinct_ratio(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "series_id"), "series_id", "l_partkey")


@query("agg5_median", f"WITH {PART_OBS} SELECT series_id, {r('quantile_cont(value, 0.5)', 'median')} FROM obs GROUP BY 1")
def _median(spark: Spark, sf: str) -> DataFrame:
    return series_medians(part_obs(spark, sf), "value")


@query("agg5_column_median", f"SELECT {r('quantile_cont(l_extendedprice, 0.5)', 'median')} FROM lineitem")
def _column_median(spark: Spark, sf: str) -> DataFrame:
    return medians(table(spark, sf, "lineitem"), "l_extendedprice")


@query("agg6_missing", f"""WITH {PART_OBS}, h AS (SELECT series_id, CASE WHEN value >= 30000 THEN value END AS value FROM obs)
 SELECT series_id, count(*) - count(value) AS missing, {r('100.0 * (count(*) - count(value)) / count(*)', 'missing_pct')} FROM h GROUP BY 1""")
def _missing(spark: Spark, sf: str) -> DataFrame:
    return A.missing_share(part_obs(spark, sf).withColumn("value", F.when(q("value") >= 30000, q("value"))))


def _pairs_sql(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs(corr(\"{a}\", \"{b}\")) AS correlation FROM {source}"
        for a, b in combinations(cols, 2))


@query("agg7_pair_correlations", f"WITH {ECONOMY}, p AS ({_pairs_sql(INDICATORS, 'econ')}) SELECT \"left\", \"right\", {r('correlation')} FROM p")
def _pairs(spark: Spark, sf: str) -> DataFrame:
    return A.pair_correlations(economy(spark, sf), INDICATORS)


@query("agg7_correlation_matrix", f"""WITH {PANEL}, p AS ({_pairs_sql(MEMBERS, 'panel')}) SELECT "left", "right", {r('correlation')} FROM p
 UNION ALL SELECT "right", "left", {r('correlation')} FROM p UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES {', '.join(f"('{c}')" for c in MEMBERS)}) t(c)""")
def _matrix(spark: Spark, sf: str) -> DataFrame:
    return A.correlation_matrix(panel(spark, sf), MEMBERS)


@query("agg7_wide_correlations", f"""WITH cells AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT a.m AS l, b.m AS r, count(*) AS n, abs(corr(a.v, b.v)) AS c FROM cells a JOIN cells b ON a.k = b.k AND a.m < b.m GROUP BY 1, 2)
 SELECT l AS "left", r AS "right", n, {r('c', 'correlation')} FROM p WHERE n > 2""")
def _wide(spark: Spark, sf: str) -> DataFrame:
    """What customers spend in a month against what they spend in another: a row per customer, a column per month, most of it empty."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    spent = table(spark, sf, "orders").withColumn("_m", month).groupBy("o_custkey").pivot("_m").agg(F.sum("o_totalprice"))
    return wide_correlations(spent, sorted(c for c in spent.columns if c != "o_custkey"), tile=32).filter("n > 2")


@query("agg8_high_pairs", f"""WITH {ECONOMY}, p AS ({_pairs_sql(INDICATORS, 'econ')}) SELECT "left", "right", {r('correlation')} FROM p
 WHERE correlation > 0.9 ORDER BY correlation DESC""")
def _high(spark: Spark, sf: str) -> DataFrame:
    return A.high_correlation_pairs(economy(spark, sf), INDICATORS)


@query("agg9_correlation_ranking", f"""WITH {PANEL}, s AS ({' UNION ALL '.join(
    f"SELECT '{f}' AS feature, coalesce(abs(corr({f}, urgent)), 0) + coalesce(abs(corr({f}, high)), 0) AS score FROM panel" for f in MEMBERS[2:])})
 SELECT feature, {r('score')} FROM s ORDER BY s.score DESC, feature LIMIT 2""")
def _ranking(spark: Spark, sf: str) -> DataFrame:
    return A.correlation_ranking(panel(spark, sf), MEMBERS[2:], MEMBERS[:2], 2)


@query("agg10_quartile_bins", f"""WITH {PART_OBS}, e AS (SELECT min(value) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c,
 quantile_cont(value, 0.75) AS dd, max(value) AS z FROM obs) SELECT series_id, {d()}, CAST((value >= b)::INTEGER + (value >= c)::INTEGER + (value >= dd)::INTEGER
 + (value >= z)::INTEGER AS BIGINT) AS bin FROM obs, e""")
def _bins(spark: Spark, sf: str) -> DataFrame:
    return A.quartile_bins(part_obs(spark, sf), "value").select("series_id", "date", "bin")


@query("agg11_fit_line", f"""WITH {PART_OBS}, x AS (SELECT *, (row_number() OVER w - 1)::DOUBLE AS t FROM obs {WIN})
 SELECT series_id, {r('regr_slope(value, t)', 'slope')}, {r('regr_intercept(value, t)', 'intercept')}, {r('regr_r2(value, t)', 'r2')} FROM x GROUP BY 1""")
def _line(spark: Spark, sf: str) -> DataFrame:
    return A.fit_line(W.time_index(part_obs(spark, sf)), "series_id", "t", "value")


# --- forecast metrics ----------------------------------------------------------------

PAIRS = f"""{PART_OBS}, pairs AS (SELECT series_id, date, value AS actual, lag(value, 1) OVER w AS forecast FROM obs {WIN}),
 good AS (SELECT * FROM pairs WHERE forecast IS NOT NULL)"""


def _forecast_pairs(spark: Spark, sf: str, lag: int = 1) -> DataFrame:
    x = W.lags(part_obs(spark, sf), [lag])
    return x.select("series_id", "date", q("value").alias("actual"), q(f"value_lag{lag}").alias("forecast")).filter("forecast is not null")


@query("agg12_mae_rmse", f"""WITH {PAIRS} SELECT series_id, {r('avg(abs(actual - forecast))', 'mae')},
 {r('sqrt(avg((actual - forecast) * (actual - forecast)))', 'rmse')} FROM good GROUP BY 1""")
def _mae(spark: Spark, sf: str) -> DataFrame:
    y, p = q("actual"), q("forecast")
    return _forecast_pairs(spark, sf).groupBy("series_id").agg(A.mae(y, p).alias("mae"), A.rmse(y, p).alias("rmse"))


_SHIFTED = f"{PAIRS}, z AS (SELECT series_id, CASE WHEN actual < 20000 THEN 0 ELSE actual - 50000 END AS actual, forecast - 50000 AS forecast FROM good)"


@query("agg13_mape_variants", f"""WITH {_SHIFTED} SELECT series_id, {r('100 * avg(CASE WHEN actual <> 0 THEN abs((actual - forecast) / nullif(actual, 0)) END)', 'skip_zero')},
 {r('100 * avg(abs((actual - forecast) / nullif(actual, 0)))', 'null_zero')}, {r('100 * avg(abs(actual - forecast) / greatest(abs(actual), 1e-8::DOUBLE)) / 1e8', 'floor')},
 {r('100 * avg(abs((actual - forecast) / greatest(actual, 1))) / 1e2', 'at_least_one')} FROM z GROUP BY 1""")
def _mape(spark: Spark, sf: str) -> DataFrame:
    z = _forecast_pairs(spark, sf).withColumns({
        "actual": F.when(q("actual") < 20000, 0.0).otherwise(q("actual") - 50000), "forecast": q("forecast") - 50000})
    y, p = q("actual"), q("forecast")
    return z.groupBy("series_id").agg(
        A.mape(y, p, "skip_zero").alias("skip_zero"), A.mape(y, p, "null_zero").alias("null_zero"),
        (A.mape(y, p, "floor") / 1e8).alias("floor"), (A.mape(y, p, "at_least_one") / 1e2).alias("at_least_one"))


def _metrics_sql(source: str = "good", key: str = "series_id") -> str:
    e = "(actual - forecast)"
    return f"""SELECT {key}, avg(abs({e})) AS mae, sqrt(avg({e} * {e})) AS rmse,
 1 - sum({e} * {e}) / nullif(var_pop(actual) * count(*), 0) AS r2, 100 * avg(abs({e} / greatest(actual, 1))) AS mape,
 max(abs({e})) AS max_error, stddev_samp({e}) AS residual_std FROM {source} GROUP BY ALL"""


_MET = ["mae", "rmse", "r2", "mape", "max_error", "residual_std"]


@query("agg14_forecast_metrics", f"WITH {PAIRS}, m AS ({_metrics_sql()}) SELECT series_id, {', '.join(r(c, c, 3) for c in _MET)} FROM m", 3)
def _metrics(spark: Spark, sf: str) -> DataFrame:
    return A.forecast_metrics(_forecast_pairs(spark, sf), "series_id")


@query("agg14_metric_means", f"""WITH {PAIRS}, m AS ({_metrics_sql()}) SELECT {', '.join(r(f'avg({c})', f'avg_{c}', 3) for c in _MET[:4])} FROM m""", 3)
def _means(spark: Spark, sf: str) -> DataFrame:
    return A.metric_means(A.forecast_metrics(_forecast_pairs(spark, sf), "series_id"))


TWO = f"""{PART_OBS}, p1 AS (SELECT 'lag1' AS architecture, series_id AS target, value AS actual, lag(value, 1) OVER w AS forecast FROM obs {WIN}),
 p2 AS (SELECT 'lag2', series_id, value, lag(value, 2) OVER w FROM obs {WIN}), both_p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
 good2 AS (SELECT * FROM both_p WHERE forecast IS NOT NULL), m AS ({_metrics_sql('good2', 'architecture, target')})"""


def _two_models(spark: Spark, sf: str) -> DataFrame:
    parts = [_forecast_pairs(spark, sf, k).withColumn("architecture", F.lit(f"lag{k}")) for k in (1, 2)]
    return A.forecast_metrics(parts[0].unionByName(parts[1]).withColumnRenamed("series_id", "target"), ["architecture", "target"])


@query("agg15_metric_table", f"""WITH {TWO} SELECT target, {', '.join(
    r(f"max(CASE WHEN architecture = '{a}' THEN {c} END)", f'{c}_{a}', 3) for c in _MET[:3] for a in ('lag1', 'lag2'))} FROM m GROUP BY 1""", 3)
def _table(spark: Spark, sf: str) -> DataFrame:
    return A.metric_table(_two_models(spark, sf), ["lag1", "lag2"], digits=8)


@query("agg16_compare_models", f"""WITH {TWO}, c AS (SELECT target, max(CASE WHEN architecture = 'lag1' THEN mae END) AS m1, max(CASE WHEN architecture = 'lag2' THEN mae END) AS m2,
 max(CASE WHEN architecture = 'lag1' THEN r2 END) AS r1, max(CASE WHEN architecture = 'lag2' THEN r2 END) AS r2 FROM m GROUP BY 1)
 SELECT target, {r('m1', 'mae_first', 3)}, {r('m2', 'mae_second', 3)}, {r('r1', 'r2_first', 3)}, {r('r2', 'r2_second', 3)},
 {r('100 * (m1 - m2) / nullif(m1, 0)', 'mae_improvement', 3)}, {r('100 * (r2 - r1) / greatest(abs(r1), 0.001::DOUBLE)', 'r2_improvement', 3)},
 CASE WHEN m2 < m1 THEN 'lag2' ELSE 'lag1' END AS winner FROM c""", 3)
def _compare(spark: Spark, sf: str) -> DataFrame:
    return A.compare_models(_two_models(spark, sf), "lag1", "lag2")


@query("agg16_model_summary", f"""WITH {TWO}, w AS (SELECT target, arg_min(architecture, (mae, architecture)) AS architecture FROM m GROUP BY 1),
 n AS (SELECT architecture, count(*) AS wins FROM w GROUP BY 1), a AS (SELECT architecture, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM m GROUP BY 1)
 SELECT architecture, {r('mae', 'mae', 3)}, {r('rmse', 'rmse', 3)}, {r('r2', 'r2', 3)}, coalesce(wins, 0) AS wins FROM a LEFT JOIN n USING (architecture)""", 3)
def _summary(spark: Spark, sf: str) -> DataFrame:
    return A.model_summary(_two_models(spark, sf))


@query("agg17_leaderboard", f"WITH {PAIRS}, m AS ({_metrics_sql()}) SELECT series_id, {r('rmse', 'rmse', 3)} FROM m ORDER BY m.rmse, series_id", 3)
def _board(spark: Spark, sf: str) -> DataFrame:
    return A.leaderboard(A.forecast_metrics(_forecast_pairs(spark, sf), "series_id")).select("series_id", "rmse")


def acf_sql(source: str, nlags: int = 10, need: int = 15) -> str:
    """Autocorrelation features of `source`(series_id, date, value) as CTE `acf`."""
    lagged = ", ".join(f"z * lag(z, {k}) OVER g AS z{k}" for k in range(1, nlags + 1))
    ratios = ", ".join(f"sum(z{k}) / nullif(sum(z * z), 0) AS r{k}" for k in range(1, nlags + 1))
    squares = " + ".join(f"r{k} * r{k}" for k in range(1, nlags + 1))
    cols = ", ".join(f"max(CASE WHEN form = '{f}' THEN {'' if f == 'original' else f'CASE WHEN n < {nlags + 2} THEN 0 ELSE '}{src}{'' if f == 'original' else ' END'} END) AS {out}_{f}"
                     for f in ("original", "diff1", "diff2") for src, out in (("r1", "first_acf"), ("ss", "sumsq_acf")))
    return f"""base AS (SELECT *, lag(value, 1) OVER w AS b1, lag(value, 2) OVER w AS b2 FROM {source} {WIN}),
 forms AS (SELECT series_id, date, 'original' AS form, value AS x FROM base UNION ALL SELECT series_id, date, 'diff1', value - b1 FROM base WHERE b1 IS NOT NULL
 UNION ALL SELECT series_id, date, 'diff2', value - 2 * b1 + b2 FROM base WHERE b2 IS NOT NULL),
 cent AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id, form) AS z FROM forms),
 prods AS (SELECT *, {lagged} FROM cent WINDOW g AS (PARTITION BY series_id, form ORDER BY date)),
 rat AS (SELECT series_id, form, count(*) AS n, {ratios} FROM prods GROUP BY 1, 2), sq AS (SELECT *, {squares} AS ss FROM rat),
 acf AS (SELECT series_id, {cols}, max(CASE WHEN form = 'original' THEN r{min(12, nlags)} END) AS seasonal_acf FROM sq
 GROUP BY 1 HAVING max(CASE WHEN form = 'original' THEN n END) >= {need})"""


ACF_COLS = [f"{a}_{f}" for f in ("original", "diff1", "diff2") for a in ("first_acf", "sumsq_acf")] + ["seasonal_acf"]


@query("agg18_acf_features", f"WITH {PART_OBS}, {acf_sql('obs')} SELECT series_id, {', '.join(r(c) for c in ACF_COLS)} FROM acf")
def _acf(spark: Spark, sf: str) -> DataFrame:
    return W.acf_features(part_obs(spark, sf))


@query("agg19_flag_counts", f"""WITH {PART_OBS}, f AS (SELECT series_id, date, (value > 60000)::INTEGER AS high, (value < 20000)::INTEGER AS low FROM obs)
 SELECT CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS split, sum(high)::BIGINT AS high, sum(low)::BIGINT AS low FROM f GROUP BY 1""")
def _flags(spark: Spark, sf: str) -> DataFrame:
    flagged = part_obs(spark, sf).withColumns({"high": (q("value") > 60000).cast("int"), "low": (q("value") < 20000).cast("int")})
    return A.flag_counts(flagged, ["high", "low"], F.when(q("date") < F.lit(SPLIT).cast("date"), "train").otherwise("test"))


_SELECTED = """sel AS (SELECT l_returnflag || l_linestatus AS target, l_suppkey AS feature, sum(l_quantity) / count(*) AS score FROM lineitem GROUP BY 1, 2),
 rk AS (SELECT target, feature, rank() OVER (PARTITION BY target ORDER BY score DESC) AS rank FROM sel)"""


def _rankings(spark: Spark, sf: str) -> DataFrame:
    scores = (table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("target"), q("l_suppkey").alias("feature"))
              .agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("score")))
    # Few targets with very many features: ranked in ranges of their scores.
    return rank_in_order(scores.withColumn("_down", -q("score")), "_down", "target").drop("_down")


@query("agg20_feature_votes", f"""WITH {_SELECTED} SELECT feature, count(*) AS votes FROM rk WHERE rank <= 30 GROUP BY 1 ORDER BY votes DESC, feature LIMIT 40""")
def _votes(spark: Spark, sf: str) -> DataFrame:
    return A.feature_votes(_rankings(spark, sf).filter("rank <= 30"))


@query("agg21_rank_scores", f"""WITH {_SELECTED} SELECT feature, {r('avg(1.0::DOUBLE / rank)', 'avg_importance')}, {r('avg((rank <= 30)::INTEGER)', 'selection_frequency')},
 {r('0.7 * avg(1.0::DOUBLE / rank) + 0.3 * avg((rank <= 30)::INTEGER)', 'combined_score')} FROM rk GROUP BY 1""")
def _scores(spark: Spark, sf: str) -> DataFrame:
    return A.rank_scores(_rankings(spark, sf).withColumn("selected", q("rank") <= 30))


@query("agg22_coverage", f"""WITH {PART_OBS} SELECT series_id, {d('min(date)', 'first')}, {d('max(date)', 'last')}, count(*) AS n_rows,
 date_diff('day', max(date), DATE '2002-01-01') AS days_old, {r('100.0 * count(*) / nullif((year(max(date)) - year(min(date))) * 12, 0)', 'completeness')} FROM obs GROUP BY 1""")
def _coverage(spark: Spark, sf: str) -> DataFrame:
    return A.coverage(part_obs(spark, sf), F.lit("2002-01-01").cast("date"))


@query("agg23_diagnostics", f"""WITH {PAIRS}, g AS (SELECT series_id, stddev_pop(forecast) AS fs, max(forecast) - min(forecast) AS fr, stddev_pop(actual) AS acs,
 100 * stddev_samp(forecast) / nullif(abs(avg(forecast)), 0) AS cv FROM good GROUP BY 1)
 SELECT series_id, {r('fs', 'forecast_std', 3)}, {r('fr', 'forecast_range', 3)}, {r('acs', 'actual_std', 3)}, {r('cv', 'cv_pct', 3)}, {r('fs / nullif(acs, 0)', 'std_ratio', 3)},
 CASE WHEN fs < 1e-6 THEN 'flat' WHEN fs / nullif(acs, 0) < 0.01 THEN 'weak' ELSE 'varied' END AS verdict FROM g""", 3)
def _diagnostics(spark: Spark, sf: str) -> DataFrame:
    return A.forecast_diagnostics(_forecast_pairs(spark, sf))


_FEATURES = all_panel_features()


def _count_sql(name: str) -> str:
    """SQL for the number of values of a derived feature, inside a window query."""
    base, kind, n = re.fullmatch(r"(.+)_(lag|roll[a-z]+|diff|pct_change)(\d+)", name).groups()
    if kind.startswith("roll"):
        return f'(count("{base}") OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n})::INTEGER AS "{name}"'
    if kind == "pct_change":
        return f'(nullif(lag("{base}", {n}) OVER w, 0) IS NOT NULL)::INTEGER AS "{name}"'
    return f'(lag("{base}", {n}) OVER w IS NOT NULL)::INTEGER AS "{name}"'


_SUMS = {f: [n for n in _FEATURES if A.family(n) == f] for f in ("lag", "rolling", "difference", "change")}


@query("agg24_family_counts", f"""WITH {ECONOMY}, x AS (SELECT {', '.join(_count_sql(n) for n in _FEATURES)} FROM econ {WIN}), t AS (SELECT {', '.join(
    f'sum({chr(34)}{n}{chr(34)})::BIGINT AS {chr(34)}{n}{chr(34)}' for n in _FEATURES)} FROM x)
 {' UNION ALL '.join(f"SELECT '{f}' AS family, {len(cols)}::BIGINT AS n, ({' + '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)})::BIGINT AS values FROM t" for f, cols in _SUMS.items())}""")
def _families(spark: Spark, sf: str) -> DataFrame:
    return A.family_counts(panel_features(economy(spark, sf), _FEATURES).select(*[q(n) for n in _FEATURES]))


# --- data quality -----------------------------------------------------------------------

def rule(name: str, column: str, count: str) -> str:
    return f"SELECT '{name}' AS rule, '{column}' AS column, CAST(coalesce({count}, 0) AS BIGINT) AS violations, coalesce({count}, 0) = 0 AS passed"


def _known(name: str, column: str, violations: int) -> str:
    return f"SELECT '{name}' AS rule, '{column}' AS column, {violations}::BIGINT AS violations, {str(violations == 0).lower()} AS passed"


@query("dq1_columns", f"""WITH {ECONOMY} {_known('columns_match_ordered_list', '*', 0)} UNION ALL {_known('has_pattern', 'rate', 0)} UNION ALL {_known('has_pattern', 'yield', 1)}
 UNION ALL {rule('not_null', 'CPI', 'count(*) - count("CPI")')} FROM econ""")
def _columns(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    return DQ.run_rules(DQ.check_columns(e, ["series_id", "date", TARGETS[0], *INDICATORS], ["rate", "yield"]), DQ.check_not_null(e, ["CPI"]))


@query("dq2_types", f"""WITH {ECONOMY} {_known('column_type', 'date', 0)} UNION ALL {_known('column_type', 'CPI', 0)} UNION ALL {_known('column_type', 'series_id', 1)}
 UNION ALL {rule('no_infinity', 'PPI', 'count(*) FILTER (isinf("PPI"))')} FROM econ""")
def _types(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    return DQ.run_rules(DQ.check_types(e, {"date": "date", "CPI": "double", "series_id": "string"}), DQ.check_finite(e, ["PPI"]))


@query("dq3_ranges", f"""WITH {ECONOMY} {rule('in_range', 'recession_probability', 'count(*) FILTER (recession_probability < 0 OR recession_probability > 100)')} FROM econ
 UNION ALL {rule('in_range', '1_year_rate', 'count(*) FILTER ("1_year_rate" < 2 OR "1_year_rate" > 6)')} FROM econ
 UNION ALL {rule('positive', 'INDPRO', 'count(*) FILTER ("INDPRO" <= 0)')} FROM econ UNION ALL {rule('positive', '3_months_rate', 'count(*) FILTER ("3_months_rate" <= 0)')} FROM econ""")
def _ranges(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    return DQ.run_rules(DQ.check_ranges(e, {"recession_probability": DQ.RANGES["percent"], "1_year_rate": (2.0, 6.0)}),
                        DQ.check_positive(e, ["INDPRO", "3_months_rate"]))


@query("dq4_not_null_unique", f"""{rule('not_null', 'event_id', 'count(*) - count(event_id)')} FROM events UNION ALL {rule('not_null', 'value', 'count(*) - count(CASE WHEN value >= 1 THEN value END)')} FROM events
 UNION ALL {rule('unique', 'event_id', 'count(*) - count(DISTINCT event_id)')} FROM events
 UNION ALL {rule('unique', 'event_type,user_id', "count(*) - count(DISTINCT event_type || '|' || user_id)")} FROM events""")
def _keys(spark: Spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("value", F.when(q("value") >= 1, q("value")))
    return DQ.run_rules(DQ.check_not_null(e, ["event_id", "value"]), DQ.check_unique(e, "event_id"), DQ.check_unique(e, ["event_type", "user_id"]))


@query("dq5_duplicates_infinite", f"""WITH num AS (SELECT event_type, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'inf'::DOUBLE ELSE value END AS value FROM events),
 du AS (SELECT count(*) AS n FROM num GROUP BY event_type, value) {rule('no_duplicate_rows', '*', 'sum(n - 1)')} FROM du
 UNION ALL {rule('no_infinity', 'value', 'count(*) FILTER (isinf(value))')} FROM num""")
def _duplicates(spark: Spark, sf: str) -> DataFrame:
    num = dirty(spark, sf).select(q("series_id").alias("event_type"), C.to_number(q("value")).alias("value"))
    return DQ.run_rules(DQ.check_duplicates(num), DQ.check_finite(num, ["value"]))


@query("dq6_scale_class", f"""WITH x AS (SELECT l_discount, l_extendedprice, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS z FROM lineitem),
 p AS ({' UNION ALL '.join(f"SELECT '{c}' AS column, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM x" for c in ('l_discount', 'l_extendedprice', 'z'))})
 SELECT p.column, {r('mean')}, {r('std')}, {r('min')}, {r('max')}, CASE WHEN abs(mean) < 0.1 AND abs(std - 1) < 0.1 THEN 'normalized'
 WHEN min >= 0 AND max <= 1 THEN 'scaled' ELSE 'raw' END AS scale FROM p""")
def _scale(spark: Spark, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    m = lines.agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")).first()
    return DQ.scale_class(lines.withColumn("z", (q("l_quantity") - m["m"]) / m["s"]), ["l_discount", "l_extendedprice", "z"])


@query("dq7_horizon_correlation", f"""WITH {ECONOMY}, t AS (SELECT recession_probability AS p0, lead(recession_probability, 1) OVER w AS p1,
 lead(recession_probability, 3) OVER w AS p3, lead(recession_probability, 6) OVER w AS p6 FROM econ {WIN}),
 c AS ({' UNION ALL '.join(f'SELECT corr({a}, {b}) AS c FROM t' for a, b in combinations(['p0', 'p1', 'p3', 'p6'], 2))})
 SELECT {r('avg(c)', 'mean_correlation')}, coalesce(avg(c) > 0.3, false) AS passed FROM c""")
def _horizon(spark: Spark, sf: str) -> DataFrame:
    return DQ.check_horizon_correlation(economy_targets(spark, sf), TARGETS)


@query("dq8_malformed", """WITH raw AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'invalid-date' WHEN event_id % 19 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date,
 CASE WHEN event_id % 17 = 0 THEN '.' WHEN event_id % 23 = 0 THEN 'inf' WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN '-999' WHEN event_id % 37 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value FROM events),
 p AS (SELECT *, TRY_CAST(date AS DATE) AS dt, TRY_CAST(value AS DOUBLE) AS v FROM raw),
 x AS (SELECT CASE WHEN date IS NULL THEN 'missing_date' WHEN dt IS NULL THEN 'bad_date' WHEN value IS NULL THEN 'missing_value' WHEN value = '' THEN 'empty_value'
 WHEN value = '.' THEN 'missing_token' WHEN v IS NULL THEN 'bad_value' WHEN isinf(v) OR isnan(v) THEN 'non_finite' WHEN v = -999 THEN 'sentinel' ELSE 'accepted' END AS reason,
 CASE WHEN isfinite(v) AND v <> -999 THEN v END AS good FROM p) SELECT reason, count(*) AS records, count(good) AS usable_values FROM x GROUP BY 1""")
def _malformed(spark: Spark, sf: str) -> DataFrame:
    n = q("event_id")
    raw = table(spark, sf, "events").select(
        F.when(n % 13 == 0, "invalid-date").when(n % 19 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(n % 17 == 0, ".").when(n % 23 == 0, "inf").when(n % 29 == 0, "").when(n % 31 == 0, "-999").when(n % 37 == 0, "n/a")
        .otherwise(q("value").cast("string")).alias("value"))
    return DQ.reject_counts(DQ.parse_records(raw))


