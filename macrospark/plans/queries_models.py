"""Queries for point-in-time values, augmented tests and vector models with regressors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from macrospark.columns import q
from macrospark.constants import DF_CRITICAL_5PCT, INDICATORS
from macrospark.operators import asof as AO, forecast as T, moving_average as MA, stationarity as S, vector as V
from macrospark.plans.catalogue import d, query, r, significant, significant_sql
from macrospark.plans.driver_tables import ECONOMY, PART_OBS, VINTAGES, economy, part_obs, table, vintages

WIN = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"


# --- point in time ------------------------------------------------------------------

def _decisions(spark: Spark, sf: str) -> DataFrame:
    """What somebody asks for: each order's customer at the order's own date."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("ask"), F.to_date("o_orderdate").alias("as_of"))


_ASKS = """asks AS (SELECT o_custkey AS series_id, o_orderkey AS ask, CAST(o_orderdate AS DATE) AS as_of FROM orders),
 one AS (SELECT series_id, realtime_start, arg_max(value, revision) AS value, max(revision) AS revision FROM vint GROUP BY 1, 2)"""


@query("src6_as_of", f"""WITH {VINTAGES}, {_ASKS} SELECT a.series_id, a.ask, {d('a.as_of', 'as_of')}, {d('o.realtime_start', 'realtime_start')}, {r('o.value', 'value')}
 FROM asks a ASOF LEFT JOIN one o ON a.series_id = o.series_id AND a.as_of >= o.realtime_start""")
def _as_of(spark: Spark, sf: str) -> DataFrame:
    return AO.as_of(vintages(spark, sf), _decisions(spark, sf), ties=["revision"])


@query("src6_as_of_until", f"""WITH {VINTAGES}, {_ASKS} SELECT a.series_id, a.ask, {d('a.as_of', 'as_of')},
 strftime(CASE WHEN a.as_of <= o.realtime_start + CAST(o.revision % 60 AS INTEGER) THEN o.realtime_start END, '%Y-%m-%d') AS realtime_start,
 {r('CASE WHEN a.as_of <= o.realtime_start + CAST(o.revision % 60 AS INTEGER) THEN o.value END', 'value')}
 FROM asks a ASOF LEFT JOIN one o ON a.series_id = o.series_id AND a.as_of >= o.realtime_start""")
def _as_of_until(spark: Spark, sf: str) -> DataFrame:
    dated = vintages(spark, sf).withColumn("realtime_end", F.date_add("realtime_start", (F.col("revision") % 60).cast("int")))
    return AO.as_of(dated, _decisions(spark, sf), end="realtime_end", ties=["revision"])


# --- augmented test -----------------------------------------------------------------

def adf_sql(source: str, lags: int, orders: int = 3) -> str:
    """CTEs order0, order1 ...: the statistic and lag count of each difference order. Lagged changes are taken out of all other columns one after another."""
    w = "OVER (PARTITION BY series_id)"
    out = [f"df AS (SELECT *, value AS d0, value - lag(value, 1) OVER w AS d1, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d2 FROM {source} {WIN})"]
    for k in range(orders):
        cols = ["y", "x", *[f"l{i}" for i in range(1, lags + 1)]]
        out.append(f"r{k} AS (SELECT series_id, d{k} - lag(d{k}) OVER w AS y, lag(d{k}) OVER w AS x, " + ", ".join(
            f"lag(d{k}, {i}) OVER w - lag(d{k}, {i + 1}) OVER w AS l{i}" for i in range(1, lags + 1)) + f" FROM df {WIN})")
        out.append(f"a{k}_0 AS (SELECT series_id, " + ", ".join(f"{c} - avg({c}) {w} AS {c}" for c in cols) + f" FROM r{k} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")")
        parts = []
        for i in range(lags + 1):
            if i:
                cols.remove(f"l{i}")
                out.append(f"a{k}_{i} AS (SELECT series_id, " + ", ".join(f"{c} - l{i} * (sum({c} * l{i}) {w} / nullif(sum(l{i} * l{i}) {w}, 0)) AS {c}" for c in cols) + f" FROM a{k}_{i - 1})")
            parts.append(f"SELECT series_id, {i} AS lags, count(*) AS n, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS sse FROM a{k}_{i} GROUP BY 1")
        out.append(f"m{k} AS (SELECT *, n * ln(greatest(sse, 1e-300::DOUBLE) / n) + 2 * (lags + 3) AS aic FROM ({' UNION ALL '.join(parts)}) WHERE n > lags + 2)")
        out.append(f"t{k} AS (SELECT series_id, sum(y * y) AS total FROM a{k}_0 GROUP BY 1)")
        out.append(f"order{k} AS (SELECT m{k}.series_id, lags, CASE WHEN sse > {T.EXACT_FIT}::DOUBLE * total THEN b / sqrt(sse / (n - lags - 2) / xx) END AS t FROM m{k} JOIN t{k} USING (series_id) "
                   f"QUALIFY row_number() OVER (PARTITION BY m{k}.series_id ORDER BY aic, lags) = 1)")
        out.append(f"c{k} AS (SELECT series_id, count(d{k}) AS v FROM df GROUP BY 1), n{k} AS (SELECT series_id, count(*) AS n FROM a{k}_0 GROUP BY 1)")
    return ", ".join(out)


@query("tso9_augmented_order", f"""WITH {PART_OBS}, {adf_sql('obs', 2)} SELECT c0.series_id, {', '.join(
    f"coalesce(n{k}.n, 0) AS n{k}, coalesce(order{k}.lags, 0) AS lags{k}, {r(f'order{k}.t', f't{k}')}" for k in range(3))},
 CASE WHEN c0.v < 20 OR coalesce(order0.t < {DF_CRITICAL_5PCT}, false) THEN 0 WHEN c1.v < 20 OR coalesce(order1.t < {DF_CRITICAL_5PCT}, false) THEN 1 ELSE 2 END::BIGINT AS d
 FROM c0 JOIN c1 USING (series_id) {' '.join(f'LEFT JOIN n{k} USING (series_id) LEFT JOIN order{k} USING (series_id)' for k in range(3))}""")
def _augmented(spark: Spark, sf: str) -> DataFrame:
    return S.augmented_order(part_obs(spark, sf), max_lags=2)


# --- vector models with regressors -----------------------------------------------------

_TARGETS = ["CPI", "PPI", "INDPRO"]
_CANDIDATES = [c for c in INDICATORS if c not in _TARGETS]
_SCORE = {c: " + ".join(f"CASE WHEN var_pop(\"{c}\") <= {V.FLAT}::DOUBLE * avg(\"{c}\" * \"{c}\") OR var_pop(\"{t}\") <= {V.FLAT}::DOUBLE * avg(\"{t}\" * \"{t}\") "
                        f"THEN 0.0 ELSE abs(corr(\"{c}\", \"{t}\")) END" for t in _TARGETS) for c in _CANDIDATES}


@query("tso15_vector_fits", f"""WITH {ECONOMY}, sc AS ({' UNION ALL '.join(f"SELECT series_id, {i} AS i, '{c}' AS c, round({s}, 9) AS s FROM econ GROUP BY 1" for i, (c, s) in enumerate(_SCORE.items()))}),
 top AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s DESC, i) AS k FROM sc),
 picked AS (SELECT series_id, string_agg(c, ',' ORDER BY k) AS regressors FROM top WHERE k <= 4 GROUP BY 1), rows AS (SELECT series_id, greatest(0, count(*) - 2 - 3) AS n FROM econ GROUP BY 1)
 SELECT series_id, regressors, n, CASE WHEN n > 8 THEN 0.0::DOUBLE END AS largest_cosine FROM rows JOIN picked USING (series_id)""")
def _vector_fits(spark: Spark, sf: str) -> DataFrame:
    """The regressors chosen for each key, and that residuals are orthogonal to every column of its model (nine or more rows: a model of one lag at least)."""
    fits = V.vector_model_fits(economy(spark, sf), _TARGETS, _CANDIDATES, orders=(1, 2, 3), d={"INDPRO": 2, "PPI": 1}, most=4)
    return fits.select("series_id", "regressors", "n", F.when(~F.isnan("largest_cosine"), F.col("largest_cosine")).alias("largest_cosine"))


_STEP = "c + a * ({}) + b * x_last"
_PATH = ["y_last"]
for _ in range(3):
    _PATH.append(_STEP.format(_PATH[-1]))


@query("tso15_vector_regressor", f"""WITH {ECONOMY}, l AS (SELECT series_id, date, "CPI" AS y, lag("CPI") OVER w AS v, "INDPRO" AS x FROM econ {WIN}),
 e AS (SELECT * FROM l WHERE v IS NOT NULL), f AS (SELECT *, x - (regr_intercept(x, v) OVER p + regr_slope(x, v) OVER p * v) AS xr, y - (regr_intercept(y, v) OVER p + regr_slope(y, v) OVER p * v) AS yr,
 regr_slope(y, v) OVER p AS s, regr_slope(x, v) OVER p AS g FROM e WINDOW p AS (PARTITION BY series_id)),
 k AS (SELECT series_id, sum(xr * yr) / sum(xr * xr) AS b, any_value(s) - any_value(g) * sum(xr * yr) / sum(xr * xr) AS a, avg(y) AS my, avg(v) AS mv, avg(x) AS mx, count(*) AS n FROM f GROUP BY 1),
 z AS (SELECT series_id, max(date) AS last, arg_max("CPI", date) AS y_last, arg_max("INDPRO", date) AS x_last FROM econ GROUP BY 1),
 j AS (SELECT *, my - a * mv - b * mx AS c FROM k JOIN z USING (series_id))
 SELECT series_id, strftime(last + to_months(step::INTEGER), '%Y-%m-%d') AS date, step, {significant_sql(f"CASE step WHEN 1 THEN {_PATH[1]} WHEN 2 THEN {_PATH[2]} ELSE {_PATH[3]} END", '"CPI"').replace('"CPI"_', 'CPI_')} FROM j, range(1, 4) t(step)""", 6)
def _vector_regressor(spark: Spark, sf: str) -> DataFrame:
    """One series, one regressor, one lag: the closed form."""
    out = V.vector_model_forecast(economy(spark, sf), ["CPI"], 3, ["INDPRO"], orders=(1,))
    return out.select("series_id", "date", "step", *significant("CPI"))


@query("tso15_vector_orders")
def _vector_orders(spark: Spark, sf: str) -> DataFrame:
    return V.vector_model_forecast(economy(spark, sf), _TARGETS, 6, _CANDIDATES, d={"INDPRO": 2, "PPI": 1})


# --- moving averages -------------------------------------------------------------------

@query("tso12_moving_average_sums", f"""WITH {PART_OBS}, z AS (SELECT series_id, date, value / coalesce(nullif(avg(abs(value)) OVER (PARTITION BY series_id), 0), 1) AS y FROM obs),
 l AS (SELECT *, lag(y) OVER w AS y1 FROM z {WIN}), f AS (SELECT series_id, regr_intercept(y, y1) AS a, regr_slope(y, y1) AS b FROM l GROUP BY 1),
 e AS (SELECT l.*, y - (a + b * y1) AS e FROM l JOIN f USING (series_id)), k AS (SELECT *, lag(e) OVER w AS e1 FROM e {WIN})
 SELECT series_id, count(*) AS n, {r('sum(y1)', 'x01')}, {r('sum(e1)', 'x02')}, {r('sum(y1 * y1)', 'x11')}, {r('sum(y1 * e1)', 'x12')}, {r('sum(e1 * e1)', 'x22')},
 {r('sum(y)', 'y0')}, {r('sum(y1 * y)', 'y1')}, {r('sum(e1 * y)', 'y2')}, {r('sum(y * y)', 'yy')} FROM k WHERE y1 IS NOT NULL AND e1 IS NOT NULL GROUP BY 1""")
def _ma_sums(spark: Spark, sf: str) -> DataFrame:
    """Sums of the second round: the lag of the series and the lag of the first round's residual."""
    g = MA.moving_average_sums(part_obs(spark, sf), 1, 1, long=1)
    cells = {"x01": 1, "x02": 2, "x11": 3, "x12": 4, "x22": 5}
    return g.select("series_id", "n", *[q("xx")[i].alias(c) for c, i in cells.items()], *[q("xy")[0][i].alias(f"y{i}") for i in range(3)], q("yy")[0].alias("yy"))


@query("tso12_moving_average")
def _ma(spark: Spark, sf: str) -> DataFrame:
    return MA.moving_average_forecast(part_obs(spark, sf), 6, d=1)
