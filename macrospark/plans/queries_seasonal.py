"""Queries for changes of trend, seasonal differencing by test and walk-forward evaluation with refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, Window, functions as F

from macrospark.operators import forecast as T, seasonal as SE, stats as A, trend_changes as TC, walk as WF
from macrospark.plans.catalogue import d, query, r, significant, significant_sql
from macrospark.plans.driver_tables import PART_OBS, SPLIT, part_obs

WIN = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"
EDGE = f"DATE '{SPLIT}'"
PERIOD = 12


# --- walk forward with refits ----------------------------------------------------------

def _refit_sql(frame: str) -> str:
    """One lag, fitted over the rows of a frame before each row. Both passes stand in SQL: centre first, products after."""
    return f"""WITH {PART_OBS}, z AS (SELECT *, lag(value) OVER w AS x FROM obs {WIN}), p AS (SELECT *, row_number() OVER w AS i FROM z {WIN}),
 e AS (SELECT a.series_id, a.date, a.value, a.x, b.x AS bx, b.value AS bv FROM p a LEFT JOIN p b ON a.series_id = b.series_id AND b.x IS NOT NULL AND b.i < a.i {frame} WHERE a.date >= {EDGE}),
 c AS (SELECT *, bx - avg(bx) OVER k AS dx, bv - avg(bv) OVER k AS dv, avg(bx) OVER k AS mx, avg(bv) OVER k AS mv FROM e WINDOW k AS (PARTITION BY series_id, date)),
 f AS (SELECT series_id, date, any_value(value) AS actual, count(bx) AS n, CASE WHEN count(bx) >= 2 AND sum(dx * dx) > 0 THEN any_value(mv) + sum(dx * dv) / sum(dx * dx) * (any_value(x) - any_value(mx)) END AS forecast FROM c GROUP BY 1, 2)
 SELECT series_id, {d()}, {r('actual')}, n, {significant_sql('forecast', 'forecast', 4)} FROM f"""


@query("tso19_refit_ar1", _refit_sql(""))
def _refit_one(spark: Spark, sf: str) -> DataFrame:
    return WF.walk_forward_refit(part_obs(spark, sf), SPLIT, (1,)).select("series_id", "date", "actual", "n", *significant("forecast"))


@query("tso19_refit_window", _refit_sql("AND b.i >= a.i - 12"))
def _refit_window(spark: Spark, sf: str) -> DataFrame:
    return WF.walk_forward_refit(part_obs(spark, sf), SPLIT, (1,), within=12).select("series_id", "date", "actual", "n", *significant("forecast"))


@query("tso19_refit")
def _refit(spark: Spark, sf: str) -> DataFrame:
    scored = WF.walk_forward_refit(part_obs(spark, sf), SPLIT)
    return A.forecast_metrics(scored, "series_id", variant="floor").select("series_id", "mae", "rmse", "mape")


# --- seasonal differencing by test -------------------------------------------------------

def root_sql(period: int) -> str:
    """CTE root: the statistic without own lags, one regressor taken out of the others first."""
    return f"""u AS (SELECT series_id, date, value / coalesce(nullif(avg(abs(value)) OVER (PARTITION BY series_id), 0), 1) AS v FROM obs),
 ud AS (SELECT *, v - lag(v) OVER w AS dd, v - lag(v, {period}) OVER w AS ss FROM u {WIN}),
 ab AS (SELECT series_id, lag(ss) OVER w AS a, lag(dd, {period}) OVER w AS b, ss - lag(ss) OVER w AS c FROM ud {WIN}),
 pr AS (SELECT series_id, b - a * (sum(a * b) OVER k / nullif(sum(a * a) OVER k, 0)) AS b, c - a * (sum(a * c) OVER k / nullif(sum(a * a) OVER k, 0)) AS c FROM ab WHERE c IS NOT NULL WINDOW k AS (PARTITION BY series_id)),
 rs AS (SELECT series_id, count(*) AS n, sum(b * c) / sum(b * b) AS beta, sum(b * b) AS bb, sum(c * c) AS total, sum(c * c) - sum(b * c) * sum(b * c) / sum(b * b) AS sse FROM pr GROUP BY 1),
 root AS (SELECT s.series_id, coalesce(n, 0) AS n, CASE WHEN n > 2 AND sse > {T.EXACT_FIT}::DOUBLE * total THEN beta / sqrt(sse / (n - 2) / bb) END AS t_stat
  FROM (SELECT DISTINCT series_id FROM obs) s LEFT JOIN rs USING (series_id))"""


@query("tso14_seasonal_test", f"""WITH {PART_OBS}, {root_sql(PERIOD)} SELECT series_id, n, 0::BIGINT AS lags, {r('t_stat')},
 CASE WHEN t_stat >= {SE.seasonal_critical(PERIOD)}::DOUBLE THEN 1 ELSE 0 END::BIGINT AS seasonal_d FROM root""")
def _seasonal_test(spark: Spark, sf: str) -> DataFrame:
    return SE.seasonal_root_test(part_obs(spark, sf), PERIOD, max_lags=0)


@query("tso14_seasonal_inverse", f"""WITH {PART_OBS}, h AS (SELECT series_id FROM obs WHERE date < {EDGE} GROUP BY 1 HAVING count(*) >= {PERIOD})
 SELECT series_id, {d()}, row_number() OVER w AS step, {r('value', 'forecast', 2)} FROM obs SEMI JOIN h USING (series_id) WHERE date >= {EDGE} {WIN}""", 2)
def _seasonal_inverse(spark: Spark, sf: str) -> DataFrame:
    """The seasonal differences after the split, put back on the season before it, are the values themselves."""
    whole = part_obs(spark, sf)
    ahead = SE.seasonal_difference(whole, PERIOD).filter(F.col("date") >= F.lit(SPLIT).cast("date")).withColumnRenamed("value", "forecast")
    last = SE.last_season(whole.filter(F.col("date") < F.lit(SPLIT).cast("date")), PERIOD).filter(F.size("season") == PERIOD)
    ahead = ahead.withColumn("step", F.row_number().over(Window.partitionBy("series_id").orderBy("date"))).join(last.select("series_id"), "series_id", "left_semi")
    return SE.undo_seasonal_difference(ahead, last, PERIOD).select("series_id", "date", "step", "forecast")


@query("tso14_seasonal_mean", f"""WITH {PART_OBS}, {root_sql(PERIOD)}, td AS (SELECT series_id, coalesce(t_stat >= {SE.seasonal_critical(PERIOD)}::DOUBLE, false) AS hit FROM root),
 sd AS (SELECT series_id, date, value, value - lag(value, {PERIOD}) OVER w AS ds, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM obs {WIN}),
 mm AS (SELECT series_id, max(date) AS last, avg(value) AS m0, avg(ds) AS m1, count(*) AS k0, count(ds) AS k1, arg_max(value, date) AS l0, arg_max(ds, date) AS l1 FROM sd GROUP BY 1),
 st AS (SELECT *, (step - 1) % {PERIOD} AS place, (step - 1) // {PERIOD} + 1 AS turns FROM mm JOIN td USING (series_id), range(1, 15) t(step))
 SELECT st.series_id, strftime(last + to_months(step::INTEGER), '%Y-%m-%d') AS date, step, hit::BIGINT AS seasonal_d,
 {significant_sql('CASE WHEN hit THEN sd.value + turns * (CASE WHEN k1 > 2 THEN m1 ELSE l1 END) WHEN k0 > 2 THEN m0 ELSE l0 END', 'forecast', 4)}
 FROM st LEFT JOIN sd ON st.series_id = sd.series_id AND sd.back = {PERIOD} - place""")
def _seasonal_mean(spark: Spark, sf: str) -> DataFrame:
    """Test, difference, mean and the way back, over more than one season."""
    out = SE.seasonal_forecast(part_obs(spark, sf), 14, PERIOD, [T.LagModel(0, ())], max_lags=0)
    return out.select("series_id", "date", "step", "seasonal_d", *significant("forecast"))


@query("tso14_seasonal_forecast")
def _seasonal_forecast(spark: Spark, sf: str) -> DataFrame:
    return SE.seasonal_forecast(part_obs(spark, sf), 12, PERIOD)


# --- changes of trend ----------------------------------------------------------------------

_PLAIN = TC.TrendChanges(pairs=0)


@query("tso13_trend_change_strength", f"""WITH {PART_OBS}, se AS (SELECT series_id, min(date) AS start, greatest(max(date) - min(date), 1) AS span FROM obs GROUP BY 1),
 uu AS (SELECT series_id, (date - start) / span::DOUBLE AS u, value FROM obs JOIN se USING (series_id)),
 ce AS (SELECT series_id, u, u - avg(u) OVER k AS cu, value - avg(value) OVER k AS cv FROM uu WINDOW k AS (PARTITION BY series_id)),
 rr AS (SELECT series_id, u, cv - cu * (sum(cu * cv) OVER k / nullif(sum(cu * cu) OVER k, 0)) AS res FROM ce WINDOW k AS (PARTITION BY series_id)),
 hs AS (SELECT series_id, i, count(*) AS n, abs(sum(greatest(u - {_PLAIN.share}::DOUBLE * i / {_PLAIN.changes}, 0) * res)) AS pull FROM rr, range(1, {_PLAIN.changes + 1}) t(i) GROUP BY 1, 2)
 SELECT series_id, max(n) AS n, {significant_sql('CASE WHEN max(n) > 3 THEN max(pull) END', 'largest_penalty', 4)} FROM hs GROUP BY 1""")
def _trend_strength(spark: Spark, sf: str) -> DataFrame:
    """The penalty from which on a series keeps one straight line."""
    return TC.fit_trend_changes(part_obs(spark, sf), settings=_PLAIN).select("series_id", "n", *significant("largest_penalty"))


@query("tso13_trend_change_optimality", f"""WITH {PART_OBS} SELECT series_id, count(*) AS n, CASE WHEN count(*) > 9 THEN 0.0::DOUBLE END AS excess, 0.0::DOUBLE AS cosine FROM obs GROUP BY 1 HAVING count(*) > 9""")
def _trend_optimality(spark: Spark, sf: str) -> DataFrame:
    """The optimality conditions of every fit, worked out anew from its rows."""
    rows = part_obs(spark, sf)
    return TC.optimality(rows, TC.fit_trend_changes(rows)).filter("n > 9")


@query("tso13_trend_change_forecast")
def _trend_forecast(spark: Spark, sf: str) -> DataFrame:
    return TC.trend_change_forecast(part_obs(spark, sf), 6)
