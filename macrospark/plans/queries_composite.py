"""Queries for decomposition, anomalies, forecasting and composite pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.constants import INDICATORS, ROW_ANOMALY_INDICATORS, ROW_FEATURES
from macrospark.operators import clean as C, decompose as D, forecast as T, joins as J, stats as A, windows as W
from macrospark.learning.models import Trees
from macrospark.operators.long_loess import decompose_loess_long
from macrospark.plans import pipelines as P
from macrospark.plans.catalogue import d, query, r, significant, significant_sql
from macrospark.plans.driver_tables import (
    ECONOMY, ECONOMY_LONG, PART_OBS, SPLIT, economy, part_obs, table,
)
from macrospark.plans.queries_stats import ACF_COLS, acf_sql
from macrospark.session import scratch_path
from macrospark.sources import sinks as K

Spark = SparkSession
WIN = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"
EDGE = f"DATE '{SPLIT}'"


def fill_sql(source: str, name: str, key: str = "series_id") -> str:
    part = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN"
    return (f"{name} AS (SELECT * EXCLUDE (value), coalesce(last_value(value IGNORE NULLS) {part} UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value(value IGNORE NULLS) {part} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {source})")


def decompose_sql(source: str, name: str, key: str = "series_id") -> str:
    """Decomposition of `source` as CTE `name`(key, date, value, trend, seasonal, residual)."""
    w = f"PARTITION BY {key} ORDER BY date"
    near = f"OVER ({w} ROWS BETWEEN"
    return f"""{name}_t AS (SELECT *, row_number() OVER w - 1 AS t, count(value) OVER (PARTITION BY {key}) AS n,
 CASE WHEN count(value) OVER f = 13 THEN (2 * sum(value) OVER f - lag(value, 6) OVER w - lead(value, 6) OVER w) / 24 END AS ma
 FROM {source} WINDOW w AS ({w}), f AS ({w} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
 {name}_r AS (SELECT *, coalesce(ma, first_value(ma IGNORE NULLS) {near} CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(ma IGNORE NULLS) {near} UNBOUNDED PRECEDING AND CURRENT ROW)) AS tr FROM {name}_t),
 {name}_m AS (SELECT *, avg(value - ma) OVER (PARTITION BY {key}, t % 12) AS m FROM {name}_r),
 {name}_c AS (SELECT *, avg(CASE WHEN t < 12 THEN m END) OVER (PARTITION BY {key}) AS c FROM {name}_m),
 {name} AS (SELECT {key}, date, value, CASE WHEN n >= 24 THEN tr END AS trend, CASE WHEN n >= 24 THEN m - c END AS seasonal,
 CASE WHEN n >= 24 THEN value - tr - (m - c) END AS residual FROM {name}_c)"""


PARTS = f"{r('trend')}, {r('seasonal')}, {r('residual')}"


@query("tso1_decompose", f"WITH {PART_OBS}, {decompose_sql('obs', 'p')} SELECT series_id, {d()}, {r('value')}, {PARTS} FROM p")
def _decompose(spark: Spark, sf: str) -> DataFrame:
    return D.decompose(part_obs(spark, sf))


@query("tso2_decompose_loess")
def _loess(spark: Spark, sf: str) -> DataFrame:
    return D.decompose_loess(part_obs(spark, sf))


_LONG_PARTS = f"""WITH f AS (SELECT event_type, event_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id),
 first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type AS series_id, event_id, {r('v', 'value')}, {r('CASE WHEN n >= 24 THEN v END', 'total')} FROM f"""


def _long_parts(spark: Spark, sf: str, robust: bool) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("event_type", "series_id")
    parts = decompose_loess_long(events, robust=robust, order=["ts", "event_id"])
    return parts.select("series_id", "event_id", "value", (F.col("trend") + F.col("seasonal") + F.col("residual")).alias("total"))


@query("tso2_long_loess", _LONG_PARTS)
def _long_loess(spark: Spark, sf: str) -> DataFrame:
    return _long_parts(spark, sf, False)


@query("tso2_long_loess_robust", _LONG_PARTS)
def _long_loess_robust(spark: Spark, sf: str) -> DataFrame:
    return _long_parts(spark, sf, True)


@query("tso2_decompose_loess_robust")
def _loess_robust(spark: Spark, sf: str) -> DataFrame:
    return D.decompose_loess(part_obs(spark, sf), robust=True)


def applied_sql(parts: str, test: str, name: str, key: str = "series_id") -> str:
    """Train decomposition `parts` applied to `test` as CTE `name`."""
    using = f"USING ({key})"
    return f"""{name}_b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS rn FROM {parts} WHERE trend IS NOT NULL),
 {name}_l AS (SELECT {key}, max(CASE WHEN rn = 1 THEN trend END) AS last_trend, count(*) AS m FROM {name}_b GROUP BY ALL),
 {fill_sql(test, name + '_f', key)},
 {name}_s AS (SELECT *, (row_number() OVER (PARTITION BY {key} ORDER BY date) - 1) % 12 AS slot FROM {name}_f),
 {name} AS (SELECT s.* EXCLUDE (slot), last_trend AS trend, b.seasonal, s.value - (last_trend + b.seasonal) AS residual FROM {name}_s s
 LEFT JOIN {name}_l {using} LEFT JOIN {name}_b b ON {' AND '.join(f's.{k.strip()} = b.{k.strip()}' for k in key.split(','))} AND 12 - b.rn = s.slot AND b.rn <= 12)"""


SPLITS = f"tr AS (SELECT * FROM obs WHERE date < {EDGE}), te AS (SELECT * FROM obs WHERE date >= {EDGE})"


@query("tso3_apply_decomposition", f"""WITH {PART_OBS}, {SPLITS}, {decompose_sql('tr', 'p')}, {applied_sql('p', 'te', 'a')}
 SELECT series_id, {d()}, {r('value')}, {PARTS} FROM a""")
def _apply(spark: Spark, sf: str) -> DataFrame:
    train, test = C.split_at(part_obs(spark, sf), SPLIT)
    return D.apply_decomposition(test, D.decomposition_params(D.decompose(train)))


@query("tso4_multiplicative", f"""WITH {PART_OBS}, lg AS (SELECT series_id, date, value AS raw, ln(value) AS value FROM obs), {decompose_sql('lg', 'p')}
 SELECT p.series_id, {d('p.date')}, {r('raw', 'value')}, {r('exp(trend)', 'trend')}, {r('exp(seasonal)', 'seasonal')}, {r('exp(residual)', 'residual')},
 {r('raw / exp(seasonal)', 'adjusted')} FROM p JOIN obs o ON o.series_id = p.series_id AND o.date = p.date, LATERAL (SELECT o.value AS raw) x""")
def _multiplicative(spark: Spark, sf: str) -> DataFrame:
    return D.decompose_multiplicative(part_obs(spark, sf))


@query("tso4_seasonally_adjusted", f"WITH {PART_OBS}, {decompose_sql('obs', 'p')} SELECT series_id, {d()}, {r('value - seasonal', 'adjusted')} FROM p")
def _adjusted(spark: Spark, sf: str) -> DataFrame:
    return D.seasonally_adjusted(D.decompose(part_obs(spark, sf))).select("series_id", "date", "adjusted")


@query("tso5_decompose_forecast", f"""WITH {PART_OBS}, l AS (SELECT series_id, max(date) AS ld, arg_max(value, date) AS value FROM obs GROUP BY 1),
 fc AS (SELECT series_id, CAST(ld + to_months(k::INTEGER) AS DATE) AS date, value + 100 * k AS value FROM l, range(1, 7) t(k)),
 un AS (SELECT * FROM obs UNION ALL SELECT * FROM fc), {decompose_sql('un', 'p')}
 SELECT p.series_id, {d('p.date')}, {r('p.value', 'value')}, {r('coalesce(trend, avg(p.value) OVER g)', 'trend')},
 {r('CASE WHEN trend IS NULL THEN p.value - avg(p.value) OVER g ELSE residual END', 'residual')}
 FROM p JOIN fc ON fc.series_id = p.series_id AND fc.date = p.date WINDOW g AS (PARTITION BY p.series_id)""")
def _tail(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    ahead = J.repeat_last(o, 6).withColumn("value", q("value") + 100 * q("step"))
    return D.decompose_forecast(o, ahead)


_BOUNDS = """bd AS (SELECT series_id, avg(residual) AS m, CASE WHEN stddev_samp(residual) = 0 THEN 1e-6::DOUBLE ELSE stddev_samp(residual) END AS s
 FROM p GROUP BY 1 HAVING count(residual) >= 10)"""
_BOTH = f"{PART_OBS}, {SPLITS}, {decompose_sql('tr', 'p')}, {applied_sql('p', 'te', 'a')}, {_BOUNDS}"
_HIT = "CASE WHEN m IS NOT NULL THEN coalesce((residual < m - 3 * s OR residual > m + 3 * s)::INTEGER, 0)::BIGINT END"


@query("snk4_decomposition_params", f"""WITH {PART_OBS}, {decompose_sql('obs', 'p')}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM p WHERE trend IS NOT NULL),
 g AS (SELECT series_id, arg_max(trend, date) AS lt, avg(residual) AS m, stddev_samp(residual) AS s, count(residual) AS n FROM k GROUP BY 1)
 SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS slot, {r('seasonal')}, {r('lt', 'last_trend')}, {r('m', 'residual_mean')},
 {r('s', 'residual_std')}, n AS residual_count FROM k JOIN g USING (series_id) WHERE rn <= 12""")
def _stl_params(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "params")
    K.save_params(D.decomposition_params(D.decompose(part_obs(spark, sf))), path)
    return K.load_params(spark, path).select(
        "series_id", F.posexplode("pattern").alias("slot", "seasonal"), "last_trend", "residual_mean", "residual_std", "residual_count")


@query("tso6_anomalies", f"""WITH {_BOTH}, un AS (SELECT series_id, date, residual, 'train' AS source FROM p UNION ALL SELECT series_id, date, residual, 'test' FROM a)
 SELECT un.series_id, {d('un.date')}, source, {r('residual')}, {_HIT} AS anomaly FROM un LEFT JOIN bd USING (series_id)""")
def _anomalies(spark: Spark, sf: str) -> DataFrame:
    flagged = D.flag_split(D.decompose_split(part_obs(spark, sf), SPLIT))
    source = F.when(q("is_train"), "train").otherwise("test").alias("source")
    return flagged.select("series_id", "date", source, "residual", "anomaly")


@query("tso7_static_bounds", f"""WITH {PART_OBS}, bd AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS s FROM obs WHERE date < {EDGE} GROUP BY 1 HAVING count(*) >= 2)
 SELECT obs.series_id, {d()}, {r('value')}, coalesce(NOT (value BETWEEN m - 1.5 * s AND m + 1.5 * s), true)::INTEGER::BIGINT AS anomaly FROM obs LEFT JOIN bd USING (series_id)""")
def _static(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    bounds = D.anomaly_bounds(C.split_at(o, SPLIT)[0], "value", sigmas=1.5, minimum=2)
    return D.flag_values(o, bounds)


@query("tso8_box_cox_lambda", f"""WITH {PART_OBS}, g AS (SELECT round(-2 + 0.05 * i, 10)::DOUBLE AS lam FROM range(0, 81) t(i)),
 v AS (SELECT series_id, lam, ln(value) AS lx, CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END AS y FROM obs, g),
 s AS (SELECT series_id, lam, (lam - 1) * sum(lx) - count(*) / 2.0::DOUBLE * CASE WHEN var_pop(y) > 0 THEN ln(var_pop(y)) END AS llf FROM v GROUP BY 1, 2)
 SELECT series_id, {r('arg_max(lam, llf)', 'lambda')}, 0.0::DOUBLE AS shift FROM s GROUP BY 1""")
def _lambda(spark: Spark, sf: str) -> DataFrame:
    # The likelihood itself is left out: for nearly constant series it is ill-conditioned.
    return T.box_cox_lambda(part_obs(spark, sf), refine=False).drop("log_likelihood")


@query("tso8_box_cox_refined")
def _refined(spark: Spark, sf: str) -> DataFrame:
    return T.box_cox_lambda(part_obs(spark, sf))


def _df_sql(k: int) -> str:
    x, y = f"x{k}", f"y{k}"
    b, sse = f"regr_slope({y}, {x})", f"(regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x}))"
    var = f"({sse} / nullif(regr_count({y}, {x}) - 2, 0) / nullif(regr_sxx({y}, {x}), 0))"
    return f"regr_count({y}, {x}) AS n{k}, CASE WHEN {sse} > {T.EXACT_FIT}::DOUBLE * regr_syy({y}, {x}) AND {var} > 0 THEN {b} / sqrt({var}) END AS t{k}"


@query("tso9_differencing_order", f"""WITH {PART_OBS}, b AS (SELECT *, value AS d0, value - lag(value, 1) OVER w AS d1,
 value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d2 FROM obs {WIN}), xy AS (SELECT series_id, {', '.join(
     f'lag(d{k}) OVER w AS x{k}, d{k} - lag(d{k}) OVER w AS y{k}' for k in range(3))} FROM b {WIN}),
 s AS (SELECT series_id, {', '.join(_df_sql(k) for k in range(3))} FROM xy GROUP BY 1)
 SELECT series_id, {', '.join(f"n{k}, {r(f't{k}')}" for k in range(3))}, CASE WHEN n0 + 1 < 20 OR coalesce(t0 < -2.86, false) THEN 0
 WHEN n1 + 1 < 20 OR coalesce(t1 < -2.86, false) THEN 1 ELSE 2 END::BIGINT AS d FROM s""")
def _order(spark: Spark, sf: str) -> DataFrame:
    return T.differencing_order(part_obs(spark, sf))


@query("tso9_augmented")
def _adf(spark: Spark, sf: str) -> DataFrame:
    return T.augmented_dickey_fuller(part_obs(spark, sf), 2)


@query("tso10_trend_forecast", f"""WITH {PART_OBS}, x AS (SELECT *, (row_number() OVER w - 1)::DOUBLE AS t FROM obs {WIN}),
 f AS (SELECT series_id, max(date) AS last, count(*) AS n, arg_max(value, date) AS tail, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(t) AS e FROM x GROUP BY 1)
 SELECT series_id, strftime(last + to_months(step::INTEGER), '%Y-%m-%d') AS date, step, {r('CASE WHEN n < 3 THEN tail ELSE a + b * (e + step) END', 'forecast')}
 FROM f, range(1, 7) t(step)""")
def _trend(spark: Spark, sf: str) -> DataFrame:
    return T.trend_forecast(part_obs(spark, sf), 6)


_X = ["value_lag1", "value_lag3"]


def _scaled_lags(spark: Spark, sf: str) -> DataFrame:
    return W.lags(part_obs(spark, sf).withColumn("value", q("value") / 1e4), [1, 3])


@query("tso11_gram", f"""WITH {PART_OBS}, z AS (SELECT series_id, value / 1e4::DOUBLE AS y, lag(value / 1e4::DOUBLE, 1) OVER w AS a, lag(value / 1e4::DOUBLE, 3) OVER w AS b FROM obs {WIN})
 SELECT series_id, count(*) AS n, {r('sum(a)', 'x01')}, {r('sum(b)', 'x02')}, {r('sum(a * a)', 'x11')}, {r('sum(a * b)', 'x12')}, {r('sum(b * b)', 'x22')},
 {r('sum(y)', 'y0')}, {r('sum(a * y)', 'y1')}, {r('sum(b * y)', 'y2')}, {r('sum(y * y)', 'yy')} FROM z WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def _gram(spark: Spark, sf: str) -> DataFrame:
    g = T.gram(_scaled_lags(spark, sf), _X, "value")
    cells = {"x01": 1, "x02": 2, "x11": 3, "x12": 4, "x22": 5}
    return g.select("series_id", "n", *[q("xx")[i].alias(c) for c, i in cells.items()],
                    *[q("xy")[0][i].alias(f"y{i}") for i in range(3)], q("yy")[0].alias("yy"))


@query("tso11_least_squares", f"""WITH {PART_OBS}, z AS (SELECT series_id, value / 1e4::DOUBLE AS y, lag(value / 1e4::DOUBLE, 1) OVER w AS a FROM obs {WIN})
 SELECT series_id, regr_count(y, a) AS n, {significant_sql('regr_intercept(y, a)', 'intercept')}, {significant_sql('regr_slope(y, a)', 'slope')} FROM z GROUP BY 1 HAVING regr_count(y, a) > 0""", 6)
def _least(spark: Spark, sf: str) -> DataFrame:
    fit = T.least_squares(_scaled_lags(spark, sf), ["value_lag1"], "value")
    fit = fit.select("series_id", "n", q("coef")[0].alias("intercept"), q("coef")[1].alias("slope"))
    return fit.select("series_id", "n", *significant("intercept"), *significant("slope"))


_AR1 = "CASE WHEN phi = 1 THEN c * step ELSE c * (1 - pow(phi, step)) / (1 - phi) END + pow(phi, step) * tail"


@query("tso12_ar1", f"""WITH {PART_OBS}, z AS (SELECT *, lag(value) OVER w AS x FROM obs {WIN}),
 f AS (SELECT series_id, max(date) AS last, arg_max(value, date) AS tail, regr_slope(value, x) AS phi, regr_intercept(value, x) AS c FROM z GROUP BY 1)
 SELECT series_id, strftime(last + to_months(step::INTEGER), '%Y-%m-%d') AS date, step, {significant_sql(_AR1, 'forecast')} FROM f, range(1, 7) t(step)""", 6)
def _ar1(spark: Spark, sf: str) -> DataFrame:
    return T.ar1_forecast(part_obs(spark, sf), 6).select("series_id", "date", "step", *significant("forecast"))


@query("tso12_auto_forecast")
def _auto(spark: Spark, sf: str) -> DataFrame:
    return T.lag_model_forecast(part_obs(spark, sf), 6)


@query("tso12_exogenous_forecast")
def _arx(spark: Spark, sf: str) -> DataFrame:
    """Every indicator of every supplier, with industrial production as regressor."""
    long = J.lengthen(economy(spark, sf), [c for c in INDICATORS if c != "INDPRO"], ["series_id", "date", "INDPRO"], "indicator", "value")
    return T.lag_model_forecast(long, 6, exogenous=["INDPRO"], key=["series_id", "indicator"])


@query("tso13_seasonal_regression")
def _seasonal_regression(spark: Spark, sf: str) -> DataFrame:
    return T.seasonal_regression_forecast(part_obs(spark, sf), 6, pairs=2)


@query("tso14_seasonal_autoregression")
def _seasonal_ar(spark: Spark, sf: str) -> DataFrame:
    return T.lag_model_forecast(part_obs(spark, sf), 12, T.SEASONAL_ORDER, pick="first")


@query("tso15_vector_forecast")
def _vector(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    return T.vector_forecast(e, INDICATORS, 6, p=2, d={"INDPRO": 1})


@query("tso16_future_exogenous", f"""WITH {ECONOMY}, l AS (SELECT series_id, max(date) AS last, arg_max("CPI", date) AS cpi, arg_max("INDPRO", date) AS ind FROM econ GROUP BY 1)
 SELECT series_id, strftime(last + to_months(step::INTEGER), '%Y-%m-%d') AS date, step, {r('CASE WHEN step <= 2 THEN cpi * 2 ELSE cpi END', '"CPI"')}, {r('ind', '"INDPRO"')}
 FROM l, range(1, 5) t(step)""")
def _exog(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf).select("series_id", "date", "CPI", "INDPRO")
    two = J.repeat_last(e, 2).select("series_id", "date", (q("CPI") * 2).alias("CPI"))
    return T.future_exogenous(e, 4, ["CPI", "INDPRO"], two)


@query("tso17_hybrid_correction")
def _hybrid(spark: Spark, sf: str) -> DataFrame:
    long = J.lengthen(economy(spark, sf), INDICATORS, ["series_id", "date"], "indicator", "value")
    by = ["series_id", "indicator"]
    base = W.rolling_previous(long, [3], ["mean"], by).select(*by, "date", q("value").alias("actual"), q("value_rollmean3").alias("base"))
    model, unit = P.fit_residual_model(base.filter("base is not null"), Trees(trees=5, depth=3), by)
    ahead = T.trend_forecast(long, 18, by).select(*by, "date", q("forecast").alias("base"))
    return P.hybrid_forecast(model, unit, ahead, by)


@query("tso18_forecast_panel")
def _panel_forecast(spark: Spark, sf: str) -> DataFrame:
    return P.forecast_panel(economy(spark, sf), 3)


@query("tso18_forecast_feature_panel")
def _feature_forecast(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    return P.forecast_feature_panel(e, P.forecast_panel(e, 3))


@query("tso19_walk_forward")
def _walk(spark: Spark, sf: str) -> DataFrame:
    scored = T.walk_forward(part_obs(spark, sf), SPLIT)
    return A.forecast_metrics(scored, "series_id", variant="floor").select("series_id", "mae", "rmse", "mape")


@query("tso19_walk_forward_ar1", f"""WITH {PART_OBS}, z AS (SELECT *, lag(value) OVER w AS x FROM obs {WIN}),
 f AS (SELECT series_id, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM z WHERE date < {EDGE} GROUP BY 1)
 SELECT z.series_id, {d('z.date')}, {r('value', 'actual', 6)}, {significant_sql('a + b * x', 'forecast')} FROM z LEFT JOIN f USING (series_id) WHERE date >= {EDGE}""", 6)
def _walk_ar1(spark: Spark, sf: str) -> DataFrame:
    out = T.walk_forward(part_obs(spark, sf), SPLIT, (1,))
    return out.select("series_id", "date", "actual", *significant("forecast"))


@query("tso20_leak_free_features", f"""WITH {_BOTH}, {acf_sql('tr')}, un AS (SELECT series_id, date, value, trend, seasonal, residual, 'train' AS source FROM p
 UNION ALL SELECT series_id, date, value, trend, seasonal, residual, 'test' FROM a) SELECT un.series_id, {d('un.date')}, {r('value')}, {PARTS}, source, {_HIT} AS anomaly,
 {', '.join(r(c) for c in ACF_COLS)} FROM un LEFT JOIN bd USING (series_id) LEFT JOIN acf USING (series_id)""")
def _leak_free(spark: Spark, sf: str) -> DataFrame:
    return P.leak_free_features(part_obs(spark, sf), SPLIT).rows


# --- regression rows ------------------------------------------------------------------

def _feature_sql(name: str) -> str:
    for kind in ("_lag", "_diff", "_pct_change", "_rollstd", "_rollmin", "_rollmax"):
        if kind in name and name[-1].isdigit():
            base, n = name.split(kind)[0], int(name.split(kind)[1])
            v = f'"{base}"'
            if kind == "_lag":
                return f"lag({v}, {n}) OVER w"
            if kind == "_diff":
                return f"{v} - lag({v}, {n}) OVER w"
            if kind == "_pct_change":
                return f"{v} / nullif(lag({v}, {n}) OVER w, 0) - 1"
            fn = {"_rollstd": "stddev_samp", "_rollmin": "min", "_rollmax": "max"}[kind]
            frame = f"OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            return f"CASE WHEN count({v}) {frame} >= {n} THEN {fn}({v}) {frame} END"
    return '"PPI" - "CPI"' if name == "PPI_CPI_diff" else f'"{name}"'


_LONG_KEY = "series_id, indicator"
_WIDE = ", ".join(f"max(CASE WHEN indicator = '{c}' THEN {p} END) AS \"{c}_{p}\"" for c in INDICATORS for p in ("trend", "residual"))
_DECOMPOSED = f"""{ECONOMY_LONG}, ltr AS (SELECT * FROM elong WHERE date < {EDGE}), lte AS (SELECT * FROM elong WHERE date >= {EDGE}),
 {decompose_sql('ltr', 'p', _LONG_KEY)}, {applied_sql('p', 'lte', 'a', _LONG_KEY)},
 un AS (SELECT series_id, indicator, date, trend, residual FROM p UNION ALL SELECT series_id, indicator, date, trend, residual FROM a),
 wide AS (SELECT series_id, date, {_WIDE} FROM un GROUP BY 1, 2), full_panel AS (SELECT econ.*, wide.* EXCLUDE (series_id, date) FROM econ LEFT JOIN wide USING (series_id, date))"""


def _raw_bounds(spark: Spark, sf: str) -> DataFrame:
    long = J.lengthen(economy(spark, sf), ROW_ANOMALY_INDICATORS, ["series_id", "date"], "indicator", "value")
    return D.anomaly_bounds(C.split_at(long, SPLIT)[0], "value", key="indicator")


@query("tso20_decomposed_panel", f"""WITH {_DECOMPOSED} SELECT series_id, {d()}, {', '.join(r(f'"{c}_{p}"') for c in INDICATORS for p in ('trend', 'residual'))} FROM full_panel""")
def _decomposed(spark: Spark, sf: str) -> DataFrame:
    out = P.decomposed_panel(economy(spark, sf), SPLIT)
    return out.select("series_id", "date", *[q(f"{c}_{p}") for c in INDICATORS for p in ("trend", "residual")])


@query("tso21_regression_rows", f"""WITH {_DECOMPOSED}, bd AS (SELECT indicator, avg(value) AS m, stddev_samp(value) AS s FROM ltr GROUP BY 1),
 feat AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn, {', '.join(f'{_feature_sql(n)} AS "f_{n}"' for n in ROW_FEATURES)},
 {', '.join(f'"{c}" AS "raw_{c}"' for c in ROW_ANOMALY_INDICATORS)} FROM full_panel {WIN})
 SELECT series_id, {d()}, {', '.join(r(f'"f_{n}"', f'"{n}"') for n in ROW_FEATURES)}, {', '.join(
     f'''(SELECT coalesce(NOT ("raw_{c}" BETWEEN m - 3 * s AND m + 3 * s), true)::INTEGER::BIGINT FROM bd WHERE indicator = '{c}') AS "{c}_anomaly"'''
     for c in ROW_ANOMALY_INDICATORS)} FROM feat WHERE rn = 1""")
def _rows(spark: Spark, sf: str) -> DataFrame:
    full = P.decomposed_panel(economy(spark, sf), SPLIT)
    return P.regression_rows(full, None, _raw_bounds(spark, sf))


@query("tso21_rows_after_forecast")
def _rows_ahead(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf)
    full = P.decomposed_panel(e, SPLIT)
    ahead = P.forecast_feature_panel(e, P.forecast_panel(e, 2))
    return P.regression_rows(full, ahead, _raw_bounds(spark, sf))


@query("udf1_per_series", f"WITH {PART_OBS} SELECT series_id, {d()}, {r('value - avg(value) OVER (PARTITION BY series_id)', 'value')} FROM obs")
def _per_series(spark: Spark, sf: str) -> DataFrame:
    from macrospark.operators.udf import apply_per_series

    def demean(pdf):
        return pdf.assign(value=pdf["value"] - pdf["value"].mean())

    return apply_per_series(part_obs(spark, sf), "series_id", demean)


