"""Queries for window operators, on many short series and on long raw ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.operators import blocks as B, clean as C, joins as J, quantiles as Q, windows as W
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import (
    EVENTS, GAPPY, OBS, PART_OBS, SPLIT, event_obs, gappy_events, obs, part_obs,
)

Spark = SparkSession
WIN = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"


def _roll(stat: str, size: int, lo: int, hi: int, need: int, name: str, value: str = "value") -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}[stat]
    frame = f"OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {lo} PRECEDING AND {hi} {'PRECEDING' if hi else 'ROW'})".replace(
        "0 ROW", "CURRENT ROW")
    return f"CASE WHEN count({value}) {frame} >= {need} THEN {fn}({value}) {frame} END AS {name}"


_FLAG_COLS = ["value_rollmean3", "value_rollstd3", "value_diff1", "value_diff3", "value_pct_change1"]


@query("flagship_latest_features", f"""WITH {PART_OBS}, x AS (SELECT series_id, date, value,
 {_roll('mean', 3, 3, 1, 3, 'value_rollmean3')}, {_roll('std', 3, 3, 1, 3, 'value_rollstd3')},
 value - lag(value, 1) OVER w AS value_diff1, value - lag(value, 3) OVER w AS value_diff3,
 value / nullif(lag(value, 1) OVER w, 0) - 1 AS value_pct_change1,
 row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs {WIN})
 SELECT series_id, {d()}, {r('value')}, {', '.join(r(c) for c in _FLAG_COLS)} FROM x WHERE rn = 1""")
def _flagship(spark: Spark, sf: str) -> DataFrame:
    x = W.rolling_previous(part_obs(spark, sf), [3], ["mean", "std"])
    return J.last_row(W.percent_change(W.differences(x, [1, 3], False)))


@query("win1_horizon_targets", f"""WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, {r('lead(value, 1) OVER w', 'value_lead1')},
 {r('lead(value, 3) OVER w', 'value_lead3')}, {r('lead(value, 6) OVER w', 'value_lead6')} FROM obs {WIN}""")
def _leads(spark: Spark, sf: str) -> DataFrame:
    return W.horizon_targets(part_obs(spark, sf))


@query("win2_lags", f"""WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, {', '.join(
    r(f'lag(value, {k}) OVER w', f'value_lag{k}') for k in (1, 3, 6, 12))} FROM obs {WIN}""")
def _lags(spark: Spark, sf: str) -> DataFrame:
    return W.lags(part_obs(spark, sf), [1, 3, 6, 12])


_R3 = [(n, s) for n in (3, 6, 12) for s in ("mean", "std", "max", "min")]


@query("win3_rolling_previous", f"""WITH {PART_OBS}, x AS (SELECT series_id, date, value, {', '.join(
    _roll(s, n, n, 1, n, f'value_roll{s}{n}') for n, s in _R3)} FROM obs)
 SELECT series_id, {d()}, {r('value')}, {', '.join(r(f'value_roll{s}{n}') for n, s in _R3)} FROM x""")
def _previous(spark: Spark, sf: str) -> DataFrame:
    return W.rolling_previous(part_obs(spark, sf))


@query("win4_rolling_min_periods", f"""WITH {PART_OBS}, x AS (SELECT series_id, date, value, {_roll('mean', 12, 11, 0, 6, 'value_mean12')},
 {_roll('std', 12, 11, 0, 6, 'value_std12')} FROM obs) SELECT series_id, {d()}, {r('value')}, {r('value_mean12')}, {r('value_std12')} FROM x""")
def _current(spark: Spark, sf: str) -> DataFrame:
    return W.rolling_current(part_obs(spark, sf), [12], ["mean", "std"], 6)


@query("win5_rolling_std_strict", f"""WITH {PART_OBS}, x AS (SELECT series_id, date, value, {_roll('std', 12, 11, 0, 12, 'value_std12')} FROM obs)
 SELECT series_id, {d()}, {r('value')}, {r('value_std12')} FROM x""")
def _strict(spark: Spark, sf: str) -> DataFrame:
    return W.rolling_current(part_obs(spark, sf), [12], ["std"], None)


_SMA = f"""{PART_OBS}, x AS (SELECT series_id, date, value, {_roll('mean', 1, 0, 0, 1, 'value_sma1')},
 {_roll('mean', 3, 2, 0, 3, 'value_sma3')}, {_roll('mean', 6, 5, 0, 6, 'value_sma6')} FROM obs)"""


@query("win6_moving_averages", f"""WITH {_SMA} SELECT series_id, {d()}, {r('value')}, {r('value_sma1')}, {r('value_sma3')}, {r('value_sma6')} FROM x""")
def _sma(spark: Spark, sf: str) -> DataFrame:
    return W.moving_averages(part_obs(spark, sf))


@query("win7_ema", f"""WITH RECURSIVE {PART_OBS}, n AS (SELECT series_id, date, value, row_number() OVER w AS rn FROM obs {WIN}),
 e(series_id, rn, date, value, e3, e6) AS (SELECT series_id, rn, date, value, value, value FROM n WHERE rn = 1
 UNION ALL SELECT n.series_id, n.rn, n.date, n.value, e.e3 * 0.5::DOUBLE + n.value * 0.5::DOUBLE,
 e.e6 * (1 - 2.0::DOUBLE / 7) + n.value * (2.0::DOUBLE / 7) FROM n JOIN e ON n.series_id = e.series_id AND n.rn = e.rn + 1)
 SELECT series_id, {d()}, {r('value')}, {r('value', 'value_ema1')}, {r('e3', 'value_ema3')}, {r('e6', 'value_ema6')} FROM e""")
def _ema(spark: Spark, sf: str) -> DataFrame:
    return B.ema(part_obs(spark, sf), [1, 3, 6], "date")


@query("win8_trend_gaps", f"""WITH {_SMA} SELECT series_id, {d()}, {r('value_sma1 - value_sma3', 'value_gap1_3')},
 {r('value_sma1 - value_sma6', 'value_gap1_6')}, {r('value_sma3 - value_sma6', 'value_gap3_6')} FROM x""")
def _gaps(spark: Spark, sf: str) -> DataFrame:
    return W.trend_gaps(W.moving_averages(part_obs(spark, sf))).drop("value", "value_sma1", "value_sma3", "value_sma6")


@query("win9_differences", f"""WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, {r('value - lag(value, 1) OVER w', 'value_diff1')},
 {r('value - lag(value, 3) OVER w', 'value_diff3')}, {r('value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w', 'value_second_diff')} FROM obs {WIN}""")
def _diffs(spark: Spark, sf: str) -> DataFrame:
    return W.differences(part_obs(spark, sf))


# Daily means of the readings, with days below a level taken as missing.
DAYS = f"""{EVENTS}, obs AS (SELECT series_id, date, CASE WHEN avg(value) >= 19 THEN round(avg(value), 8) END AS value FROM ev GROUP BY 1, 2)"""


def _days(spark: Spark, sf: str) -> DataFrame:
    return event_obs(spark, sf).groupBy("series_id", "date").agg(
        F.when(F.avg("value") >= 19, F.round(F.avg("value"), 8)).alias("value"))


_FFILL = "last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BFILL = "first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("win10_percent_change", f"""WITH {DAYS}, p AS (SELECT series_id, date, value, {_FFILL} AS pad FROM obs)
 SELECT series_id, {d()}, {r('value')}, {r('pad / nullif(lag(pad, 1) OVER w, 0) - 1', 'value_pct_change1')} FROM p {WIN}""")
def _pct(spark: Spark, sf: str) -> DataFrame:
    return W.percent_change(_days(spark, sf))


@query("win11_forward_fill", f"WITH {DAYS} SELECT series_id, {d()}, {r(_FFILL, 'value')} FROM obs")
def _ffill(spark: Spark, sf: str) -> DataFrame:
    return W.forward_fill(_days(spark, sf))


@query("win12_backward_fill", f"WITH {DAYS} SELECT series_id, {d()}, {r(_BFILL, 'value')} FROM obs")
def _bfill(spark: Spark, sf: str) -> DataFrame:
    return W.backward_fill(_days(spark, sf))


# Monthly revenue with cheap months taken as missing.
HOLES = PART_OBS.replace("obs AS", "full_obs AS") + ", obs AS (SELECT series_id, date, CASE WHEN value >= 30000 THEN value END AS value FROM full_obs)"


def _holes(spark: Spark, sf: str) -> DataFrame:
    return part_obs(spark, sf).withColumn("value", F.when(q("value") >= 30000, q("value")))


def _in_year(expr: str) -> str:
    return expr.replace("PARTITION BY series_id", "PARTITION BY series_id, year(date)")


@query("win13_fill_within_year", f"WITH {HOLES} SELECT series_id, {d()}, {r(f'coalesce({_in_year(_FFILL)}, {_in_year(_BFILL)})', 'value')} FROM obs")
def _year(spark: Spark, sf: str) -> DataFrame:
    return W.fill_within_year(_holes(spark, sf))


def _interp(source: str) -> str:
    return f"""pos AS (SELECT *, row_number() OVER {WIN[12:]} AS p FROM {source}),
 k AS (SELECT *, {_FFILL} AS v0, {_BFILL} AS v1, {_FFILL.replace('last_value(value', 'last_value(CASE WHEN value IS NOT NULL THEN p END')} AS p0,
 {_BFILL.replace('first_value(value', 'first_value(CASE WHEN value IS NOT NULL THEN p END')} AS p1 FROM pos),
 filled AS (SELECT series_id, date, coalesce(value, v0 + (v1 - v0) * ((p - p0)::DOUBLE / nullif(p1 - p0, 0)), v0) AS value FROM k)"""


@query("win14_upsample_monthly", f"""WITH {PART_OBS}, qtr AS (SELECT series_id, CAST(date_trunc('quarter', date) AS DATE) AS date, round(sum(value), 2) AS value FROM obs GROUP BY 1, 2),
 spine AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM qtr GROUP BY 1),
 j AS (SELECT s.series_id, s.date, q.value FROM spine s LEFT JOIN qtr q ON q.series_id = s.series_id AND q.date = s.date),
 {_interp('j')} SELECT series_id, {d()}, {r('value')} FROM filled""")
def _upsample(spark: Spark, sf: str) -> DataFrame:
    quarter = F.trunc("date", "quarter").alias("date")
    return W.upsample_monthly(part_obs(spark, sf).groupBy("series_id", quarter).agg(F.round(F.sum("value"), 2).alias("value")))


@query("win15_interpolate_full", f"""WITH {HOLES}, {_interp('obs')} SELECT series_id, {d()},
 {r(f'coalesce({_FFILL}, {_BFILL})', 'value')} FROM filled""")
def _full(spark: Spark, sf: str) -> DataFrame:
    return W.interpolate_full(_holes(spark, sf))


@query("win16_fill_cascade", f"""WITH {HOLES}, m AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM obs WHERE date < DATE '{SPLIT}' GROUP BY 1),
 f AS (SELECT series_id, date, coalesce({_FFILL}, {_BFILL}) AS value FROM obs)
 SELECT f.series_id, {d()}, {r('coalesce(value, med, 0)', 'value')} FROM f LEFT JOIN m USING (series_id)""")
def _cascade(spark: Spark, sf: str) -> DataFrame:
    rows = _holes(spark, sf)
    train, _ = C.split_at(rows, SPLIT)
    return W.fill_cascade(rows, Q.series_medians(train, "value"))


@query("win17_undo_differencing", f"WITH {PART_OBS}, x AS (SELECT *, row_number() OVER w AS rn FROM obs {WIN}) SELECT series_id, {d()}, {r('value')} FROM x WHERE rn > 2")
def _undo(spark: Spark, sf: str) -> DataFrame:
    placed = W.time_index(part_obs(spark, sf))
    second = W.differences(placed, [], True).filter("t >= 2").select(
        "series_id", "date", q("value_second_diff").alias("value"))
    # Levels as they stand before the first second difference.
    return W.undo_differencing(second, W.last_levels(placed.filter("t < 2"), 2), 2)


@query("win18_expanding_acf", f"""WITH {OBS}, n AS (SELECT *, row_number() OVER w AS rn FROM obs {WIN}),
 h AS (SELECT a.series_id, a.date, a.value AS last_value, b.value, b.rn, lag(b.value, 1) OVER g AS p1, lag(b.value, 2) OVER g AS p2
 FROM n a JOIN n b ON b.series_id = a.series_id AND b.rn <= a.rn WINDOW g AS (PARTITION BY a.series_id, a.date ORDER BY b.rn)),
 u AS (SELECT series_id, date, last_value, rn, 'original' AS form, value AS x FROM h UNION ALL
 SELECT series_id, date, last_value, rn, 'diff1', value - p1 FROM h WHERE p1 IS NOT NULL UNION ALL
 SELECT series_id, date, last_value, rn, 'diff2', value - 2 * p1 + p2 FROM h WHERE p2 IS NOT NULL),
 c AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id, date, form) AS z FROM u),
 l AS (SELECT *, {', '.join(f'z * lag(z, {k}) OVER g AS z{k}' for k in range(1, 11))} FROM c WINDOW g AS (PARTITION BY series_id, date, form ORDER BY rn)),
 s AS (SELECT series_id, date, last_value, form, count(*) AS n, {', '.join(f'sum(z{k}) / sum(z * z) AS r{k}' for k in range(1, 11))} FROM l GROUP BY ALL),
 f AS (SELECT *, {' + '.join(f'r{k} * r{k}' for k in range(1, 11))} AS ss FROM s)
 SELECT series_id, {d()}, {r('last_value', 'value')}, {', '.join(
     r(f"max(CASE WHEN form = '{form}' AND n > 10 THEN {src} END)", f'{out}_{form}') for form in ('original', 'diff1', 'diff2')
     for src, out in (('r1', 'acf1'), ('ss', 'sumsq_acf')))} FROM f GROUP BY series_id, date, last_value""")
def _expanding(spark: Spark, sf: str) -> DataFrame:
    return W.expanding_acf(obs(spark, sf))


@query("win19_time_index", f"WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, row_number() OVER w - 1 AS t FROM obs {WIN}")
def _index(spark: Spark, sf: str) -> DataFrame:
    return W.time_index(part_obs(spark, sf))


@query("win20_sequences", f"""WITH {PART_OBS}, x AS (SELECT series_id, date, value, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2,
 lag(value, 3) OVER w AS v3, lead(value, 1) OVER w AS y FROM obs {WIN})
 SELECT series_id, {d()}, {r('v3', 'x0')}, {r('v2', 'x1')}, {r('v1', 'x2')}, {r('value', 'x3')}, {r('y')} FROM x
 WHERE v3 IS NOT NULL AND y IS NOT NULL""")
def _sequences(spark: Spark, sf: str) -> DataFrame:
    s = W.sequences(part_obs(spark, sf), 4)
    return s.select("series_id", "date", *[F.col("x")[i][0].alias(f"x{i}") for i in range(4)], "y")


_RES = ([(f"lag(residual, {k}) OVER w", f"residual_lag_{k}") for k in range(1, 6)]
        + [(f"lag(value, {k}) OVER w", f"series_lag_{k}") for k in range(1, 4)])
_RES_ROLL = ([("residual", n, s, m) for n in (3, 5) for s, m in (("ma", "mean"), ("std", "std"))]
             + [("value", n, s, m) for n in (3, 5, 10) for s, m in (("ma", "mean"), ("std", "std"))])


def _named(c: str, n: int, s: str) -> str:
    return f"{'residual' if c == 'residual' else 'series'}_{s}_{n}"


@query("win21_residual_features", f"""WITH {PART_OBS}, b AS (SELECT *, value - lag(value, 1) OVER w AS residual FROM obs {WIN}),
 x AS (SELECT series_id, date, {', '.join(f'{e} AS {n}' for e, n in _RES)}, {', '.join(
     _roll(m, n, n - 1, 0, 1, _named(c, n, s), c) for c, n, s, m in _RES_ROLL)} FROM b {WIN})
 SELECT series_id, {d()}, {', '.join(r(n) for _, n in _RES)}, {', '.join(r(_named(c, n, s)) for c, n, s, m in _RES_ROLL)} FROM x""")
def _residual(spark: Spark, sf: str) -> DataFrame:
    base = W.differences(part_obs(spark, sf), [1], False).withColumnRenamed("value_diff1", "residual")
    return W.residual_features(base, "residual", "value").drop("residual", "value")


@query("win22_changing_variance", f"""WITH {PART_OBS}, x AS (SELECT series_id, {_roll('mean', 12, 11, 0, 6, 'm')}, {_roll('std', 12, 11, 0, 6, 's')} FROM obs),
 y AS (SELECT series_id, count(*) AS points, regr_r2(s, m) AS r2 FROM x WHERE m IS NOT NULL AND s IS NOT NULL GROUP BY 1)
 SELECT series_id, points, {r('r2')}, points > 5 AND coalesce(r2 > 0.5, false) AS changing FROM y""")
def _variance(spark: Spark, sf: str) -> DataFrame:
    return W.changing_variance(part_obs(spark, sf))


@query("win23_tile_pattern", f"""WITH {PART_OBS}, tr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs WHERE date < DATE '{SPLIT}'),
 te AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY date) - 1) % 12 AS slot FROM obs WHERE date >= DATE '{SPLIT}')
 SELECT te.series_id, {d('te.date')}, {r('te.value', 'value')}, {r('tr.value', 'seasonal')} FROM te
 LEFT JOIN tr ON tr.series_id = te.series_id AND 12 - tr.rn = te.slot AND tr.rn <= 12""")
def _tile(spark: Spark, sf: str) -> DataFrame:
    train, test = C.split_at(part_obs(spark, sf), SPLIT)
    return W.tile_pattern(test, W.last_pattern(train, "value"))


# --- long series, in blocks -------------------------------------------------------

EW = "(PARTITION BY series_id ORDER BY ts, event_id)"
AT = ["ts", "event_id"]


def _blocked(df: DataFrame) -> DataFrame:
    return B.add_range_block(df, "ts")


@query("win2_lags_long", f"""WITH {EVENTS} SELECT event_id, {r(f'lag(value, 1) OVER {EW}', 'value_lag1')}, {r(f'lag(value, 6) OVER {EW}', 'value_lag6')} FROM ev""")
def _lags_long(spark: Spark, sf: str) -> DataFrame:
    out = B.in_blocks(_blocked(event_obs(spark, sf)), lambda x, k: W.lags(x, [1, 6], k, AT), AT, earlier=6)
    return out.select("event_id", "value_lag1", "value_lag6")


@query("win3_rolling_long", f"""WITH {EVENTS}, x AS (SELECT event_id, count(value) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s
 FROM ev WINDOW f AS (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
 SELECT event_id, {r('CASE WHEN n >= 12 THEN m END', 'value_rollmean12')}, {r('CASE WHEN n >= 12 THEN s END', 'value_rollstd12')} FROM x""")
def _roll_long(spark: Spark, sf: str) -> DataFrame:
    out = B.in_blocks(_blocked(event_obs(spark, sf)), lambda x, k: W.rolling_previous(x, [12], ["mean", "std"], k, AT), AT, earlier=12)
    return out.select("event_id", "value_rollmean12", "value_rollstd12")


@query("win7_ema_long", f"""WITH RECURSIVE {EVENTS}, n AS (SELECT series_id, event_id, value, row_number() OVER {EW} AS rn FROM ev),
 e(series_id, rn, event_id, e12) AS (SELECT series_id, rn, event_id, value FROM n WHERE rn = 1
 UNION ALL SELECT n.series_id, n.rn, n.event_id, e.e12 * (11.0::DOUBLE / 13) + n.value * (2.0::DOUBLE / 13)
 FROM n JOIN e ON n.series_id = e.series_id AND n.rn = e.rn + 1) SELECT event_id, {r('e12', 'value_ema12')} FROM e""")
def _ema_long(spark: Spark, sf: str) -> DataFrame:
    return B.ema(_blocked(event_obs(spark, sf)), 12, AT, block="block").select("event_id", "value_ema12")


_LONG_FF = f"last_value(value IGNORE NULLS) OVER {EW[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LONG_BF = f"first_value(value IGNORE NULLS) OVER {EW[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("win11_forward_fill_long", f"WITH {GAPPY} SELECT event_id, {r(_LONG_FF, 'value')} FROM ev")
def _ffill_long(spark: Spark, sf: str) -> DataFrame:
    return B.forward_fill(_blocked(gappy_events(spark, sf)), AT).select("event_id", "value")


@query("win12_backward_fill_long", f"WITH {GAPPY} SELECT event_id, {r(_LONG_BF, 'value')} FROM ev")
def _bfill_long(spark: Spark, sf: str) -> DataFrame:
    return B.backward_fill(_blocked(gappy_events(spark, sf)), AT).select("event_id", "value")


@query("win17_running_sum_long", f"WITH {EVENTS} SELECT event_id, {r(f'sum(value) OVER {EW}', 'running_sum')} FROM ev")
def _sum_long(spark: Spark, sf: str) -> DataFrame:
    return B.running_sum(_blocked(event_obs(spark, sf)), AT).select("event_id", "running_sum")


@query("win19_time_index_long", f"WITH {EVENTS} SELECT event_id, row_number() OVER {EW} - 1 AS t FROM ev")
def _index_long(spark: Spark, sf: str) -> DataFrame:
    return B.row_index(_blocked(event_obs(spark, sf)), AT).select("event_id", "t")


@query("agg5_median_long", f"""WITH e AS (SELECT event_type AS series_id, value FROM events)
 SELECT series_id, {r('quantile_cont(value, 0.5)', 'median')} FROM e GROUP BY 1""")
def _median_long(spark: Spark, sf: str) -> DataFrame:
    return Q.medians(event_obs(spark, sf), "value", "series_id")


