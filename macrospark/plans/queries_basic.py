"""Queries for sources, sinks, projections, filters, joins, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.constants import INDICATORS, LABEL_CANDIDATES
from macrospark.functions import scalar as S
from macrospark.operators import clean as C, joins as J, stats as A, windows as W
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import (
    DIRTY, ECONOMY, MEMBERS, OBS, PANEL, PART_OBS, PRIORITIES, SPLIT, VINTAGES,
    dirty, economy, event_obs, obs, panel, part_obs, table, vintages,
)
from macrospark.session import scratch_path
from macrospark.sources import readers as R, sinks as K

Spark = SparkSession


# --- sources ---------------------------------------------------------------------

@query("src1_payloads", f"WITH {PART_OBS} SELECT CAST(series_id AS VARCHAR) AS series_id, {d()}, {r('value')} FROM obs")
def _payloads(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "payloads")
    point = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("value"))
    payload = part_obs(spark, sf).groupBy(F.col("series_id").cast("string").alias("series_id")).agg(
        F.array_sort(F.collect_list(point)).alias("observations"))
    payload.write.json(path)
    return R.read_payloads(spark, path).select("series_id", "date", R.numeric(q("value")).alias("value"))


@query("src2_csv", f"WITH {VINTAGES} SELECT {d('realtime_start', 'realtime_start')}, {d()}, {r('value')} FROM vint")
def _csv(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    vint = vintages(spark, sf).select("realtime_start", F.col("realtime_start").alias("realtime_end"), "date", "value")
    K.write_panel(vint, path, "csv")
    return R.read_csv(spark, path).select("realtime_start", "date", R.numeric(q("value")).alias("value"))


@query("src3_since", f"""SELECT o_orderkey, {d('o_orderdate', 'o_orderdate')}, {r('o_totalprice')}
 FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}'""")
def _since(spark: Spark, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return R.since(orders, SPLIT, "o_orderdate").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("src4_catalog", f"""WITH {OBS}, cat(series_id, indicator) AS (VALUES
 {', '.join(f"('{a}', '{b}')" for a, b in PRIORITIES.items())})
 SELECT indicator, {d()}, {r('value')} FROM obs JOIN cat USING (series_id)""")
def _catalog(spark: Spark, sf: str) -> DataFrame:
    return R.with_indicator(obs(spark, sf), PRIORITIES).select("indicator", "date", "value")


@query("src5_latest", f"""WITH {DIRTY}, x AS (SELECT *, TRY_CAST(value AS DOUBLE) AS num,
 row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) AS rn FROM dirty)
 SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
 round(CASE WHEN isfinite(num) THEN num END, 4) AS value FROM x WHERE rn = 1""")
def _latest(spark: Spark, sf: str) -> DataFrame:
    return R.latest_values(dirty(spark, sf), order=["ts", "event_id"])


@query("src6_vintages", f"""WITH {VINTAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id, date
 ORDER BY realtime_start DESC, revision DESC) AS rn FROM vint)
 SELECT series_id, {d()}, {r('value')}, {d('realtime_start', 'realtime_start')} FROM x WHERE rn = 1""")
def _vintages(spark: Spark, sf: str) -> DataFrame:
    return R.resolve_vintages(vintages(spark, sf), vintage=["realtime_start", "revision"])


# --- sinks -----------------------------------------------------------------------

@query("snk1_write_panel", f"WITH {OBS} SELECT series_id, {d()}, {r('value')} FROM obs")
def _write(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    K.write_panel(obs(spark, sf), path, partition="series_id")
    return spark.read.schema("date date, value double, series_id string").parquet(path).select("series_id", "date", "value")


_EXPORTED = ["recession_probability", *INDICATORS]


@query("snk2_columnar_export", f"""WITH {ECONOMY} SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS position, {d()},
 {', '.join(r(f'coalesce("{c}", 0)', f'"{c}"') for c in _EXPORTED)} FROM econ""")
def _export(spark: Spark, sf: str) -> DataFrame:
    arrays = K.columnar_export(economy(spark, sf), _EXPORTED, "series_id")
    # Taken apart again by position, so that the order inside the arrays shows.
    zipped = F.arrays_zip(q("dates"), *[q(c) for c in _EXPORTED])
    rows = arrays.select("series_id", F.posexplode(zipped).alias("position", "p"))
    return rows.select("series_id", "position", F.col("p.dates").alias("date"), *[F.col("p")[c].alias(c) for c in _EXPORTED])


@query("snk3_snapshot_map", f"""WITH {PART_OBS} SELECT CAST(series_id AS VARCHAR) AS label, {r('arg_max(value, date)', 'value')}, '2002-01-01T00:00:00' AS updated_at FROM obs GROUP BY series_id""")
def _snapshot(spark: Spark, sf: str) -> DataFrame:
    latest = R.latest_values(part_obs(spark, sf), text=False).withColumn("series_id", q("series_id").cast("string"))
    one = K.snapshot_map(latest, updated_at=F.lit("2002-01-01T00:00:00"))
    return one.select(F.explode("values").alias("label", "value"), "updated_at")


@query("snk4_params", f"""WITH {PART_OBS} SELECT series_id, {r('avg(value)', 'mean', 3)},
 count(*) AS n FROM obs GROUP BY series_id""", 3)
def _params(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "params")
    fitted = part_obs(spark, sf).groupBy("series_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    K.save_params(fitted, path)
    return K.load_params(spark, path)



# --- projections -------------------------------------------------------------------

@query("prj1_name_value", f"WITH {PART_OBS} SELECT series_id, {d()}, {r('value', 'revenue')} FROM obs")
def _rename(spark: Spark, sf: str) -> DataFrame:
    return C.name_value(part_obs(spark, sf), "revenue")


@query("prj2_drop_columns", f"""SELECT o_orderkey, o_custkey, o_orderpriority, {r('o_totalprice')},
 {d('o_orderdate', 'o_orderdate')} FROM orders""")
def _drop(spark: Spark, sf: str) -> DataFrame:
    return C.drop_columns(table(spark, sf, "orders"), "o_orderstatus").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("prj3_to_number", f"""WITH {DIRTY} SELECT event_id, CASE WHEN isinf(TRY_CAST(value AS DOUBLE)) THEN 1e9
 ELSE round(TRY_CAST(value AS DOUBLE), 4) END AS value FROM dirty""")
def _number(spark: Spark, sf: str) -> DataFrame:
    num = C.to_number(q("value"))
    return dirty(spark, sf).select("event_id", F.when(F.abs(num) == float("inf"), 1e9).otherwise(num).alias("value"))


@query("prj4_blank_tokens", f"WITH {DIRTY} SELECT event_id, nullif(value, '.') IS NULL AS missing FROM dirty")
def _tokens(spark: Spark, sf: str) -> DataFrame:
    return dirty(spark, sf).select("event_id", C.blank_tokens(q("value")).isNull().alias("missing"))


_NUM = f"{DIRTY}, num AS (SELECT event_id, TRY_CAST(value AS DOUBLE) AS value FROM dirty)"


@query("prj5_null_non_finite", f"""WITH {_NUM} SELECT event_id,
 round(CASE WHEN isfinite(value) THEN value END, 4) AS value FROM num""")
def _null(spark: Spark, sf: str) -> DataFrame:
    return C.null_non_finite(dirty(spark, sf).select("event_id", C.to_number(q("value")).alias("value")))


@query("prj6_zero_non_finite", f"""WITH {_NUM} SELECT event_id,
 coalesce(round(CASE WHEN isfinite(value) THEN value END, 4), 0) AS value FROM num""")
def _zero(spark: Spark, sf: str) -> DataFrame:
    return C.zero_non_finite(dirty(spark, sf).select("event_id", C.to_number(q("value")).alias("value")))


@query("prj7_sanitize", f"""WITH {PANEL} SELECT {d('date', '"month_"')}, {r('urgent', '"urgent_usd_"')},
 {r('high', '"high_usd"')} FROM panel""")
def _sanitize(spark: Spark, sf: str) -> DataFrame:
    odd = panel(spark, sf).select(F.col("date").alias("month?!"), F.col("urgent").alias("urgent (usd)"),
                                  F.col("high").alias("high-usd"))
    return C.sanitize_columns(odd)


@query("prj8_keep_matching", f"""WITH {PART_OBS}, x AS (SELECT *, lag(value, 1) OVER w AS value_lag1,
 lag(value, 3) OVER w AS value_lag3 FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY date))
 SELECT series_id, {d()}, {r('value_lag1')}, {r('value_lag3')} FROM x""")
def _matching(spark: Spark, sf: str) -> DataFrame:
    wide = W.differences(W.lags(part_obs(spark, sf), [1, 3]))
    return C.keep_matching(wide, ["series_id", "date"], contains="_lag")


@query("prj9_exogenous", f"""WITH {PANEL} SELECT {d()}, {', '.join(r(c) for c in MEMBERS if c != 'high')} FROM panel""")
def _exog(spark: Spark, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return p.select("date", *C.exogenous_columns(p.columns, "high"))


@query("prj10_require_columns", f"""WITH {PANEL} SELECT {d()}, {r('low')}, CAST(0.0 AS DOUBLE) AS absent,
 {r('urgent')} FROM panel""")
def _require(spark: Spark, sf: str) -> DataFrame:
    return C.require_columns(panel(spark, sf), ["low", "absent", "urgent"], "date")


_LEFT, _RIGHT = MEMBERS, ["series_id", "value"]


@query("prj11_schema_diff", f"WITH {PANEL} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS column, 'left' AS only_in, count({c}) AS values FROM panel" for c in _LEFT]
    + [f"SELECT '{c}', 'right', count({c}) FROM obs" for c in _RIGHT]))
def _diff(spark: Spark, sf: str) -> DataFrame:
    left, right = panel(spark, sf), obs(spark, sf)
    held = [f.agg(*[F.count(q(c)).alias(c) for c in cols]).unpivot([], [q(c) for c in cols], "column", "values")
            for f, cols in ((left, _LEFT), (right, _RIGHT))]
    return C.schema_diff(left, right).join(held[0].unionByName(held[1]), "column")


@query("prj12_constant", f"WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, 'USA' AS country FROM obs")
def _constant(spark: Spark, sf: str) -> DataFrame:
    return C.constant_column(part_obs(spark, sf), "country", "USA")


@query("prj13_ordinals", f"""WITH {PART_OBS} SELECT series_id, {d()}, CAST(quarter(date) AS BIGINT) AS quarter_number,
 CAST(month(date) AS BIGINT) AS month_number FROM obs""")
def _ordinals(spark: Spark, sf: str) -> DataFrame:
    return part_obs(spark, sf).select("series_id", "date", C.quarter_number(S.quarter_label(q("date"))).alias("quarter_number"),
                                      C.month_number(S.month_name(q("date"))).alias("month_number"))


# --- filters -------------------------------------------------------------------------

@query("flt1_split", f"""WITH {PART_OBS} SELECT CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS part,
 count(*) AS n, {r('sum(value)', 'total', 2)} FROM obs GROUP BY 1""", 2)
def _split(spark: Spark, sf: str) -> DataFrame:
    train, test = C.split_at(part_obs(spark, sf), SPLIT)
    return J.stack({"train": train, "test": test}, "part").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("flt2_split_tail", f"""WITH {PART_OBS}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
 count(*) OVER (PARTITION BY series_id) AS n FROM obs)
 SELECT series_id, {d()}, {r('value')}, rn > n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS is_test FROM x""")
def _tail(spark: Spark, sf: str) -> DataFrame:
    return C.split_tail(part_obs(spark, sf), 0.2)


@query("flt3_complete_rows", f"""WITH {PANEL} SELECT {d()}, {', '.join(r(c) for c in MEMBERS)} FROM panel
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MEMBERS)}""")
def _complete(spark: Spark, sf: str) -> DataFrame:
    return C.complete_rows(panel(spark, sf))


@query("flt4_varying_series", f"""WITH {PART_OBS}, v AS (SELECT series_id FROM obs WHERE date < DATE '{SPLIT}'
 GROUP BY 1 HAVING count(DISTINCT value) > 1)
 SELECT series_id, {d()}, {r('value')} FROM obs WHERE series_id IN (SELECT series_id FROM v)""")
def _varying(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    return C.varying_series(o, C.split_at(o, SPLIT)[0])


@query("flt4_varying_columns", f"WITH {PANEL} SELECT {d()}, {', '.join(r(c) for c in MEMBERS)} FROM panel")
def _varying_columns(spark: Spark, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("flat", F.lit(1.0))
    train, _ = C.split_at(p, SPLIT)
    return p.select("date", *C.varying_columns(train, [*MEMBERS, "flat"]))


@query("flt5_dense_series", f"""WITH {DIRTY}, x AS (SELECT date, series_id, event_id, TRY_CAST(value AS DOUBLE) AS v FROM dirty),
 k AS (SELECT series_id, date FROM x GROUP BY 1, 2 HAVING avg(CASE WHEN isfinite(v) THEN 0.0 ELSE 1.0 END) <= 0.1)
 SELECT x.series_id, {d('x.date')}, event_id, round(CASE WHEN isfinite(v) THEN v END, 4) AS value
 FROM x JOIN k ON x.series_id = k.series_id AND x.date = k.date""")
def _dense(spark: Spark, sf: str) -> DataFrame:
    num = dirty(spark, sf).select("series_id", "date", "event_id", R.numeric(q("value")).alias("value"))
    return C.dense_series(num, ["series_id", "date"], max_missing=0.1)


@query("flt6_minimum_history", f"""WITH {PART_OBS} SELECT series_id, {d()}, {r('value')} FROM obs WHERE series_id IN
 (SELECT series_id FROM obs GROUP BY 1 HAVING count(value) >= 24)""")
def _history(spark: Spark, sf: str) -> DataFrame:
    return C.minimum_history(part_obs(spark, sf), 24)


@query("flt7_last_points", f"""WITH {PART_OBS}, x AS (SELECT *, row_number() OVER
 (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs) SELECT series_id, {d()}, {r('value')} FROM x WHERE rn <= 6""")
def _points(spark: Spark, sf: str) -> DataFrame:
    return C.last_points(part_obs(spark, sf), 6)


@query("flt7_last_months", f"""WITH {PART_OBS}, x AS (SELECT *, date > (SELECT max(date) FROM obs) - INTERVAL 3 MONTH AS inside,
 row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs),
 y AS (SELECT *, bool_or(inside) OVER (PARTITION BY series_id) AS has_any FROM x)
 SELECT series_id, {d()}, {r('value')} FROM y WHERE inside OR (NOT has_any AND rn <= 2)""")
def _months(spark: Spark, sf: str) -> DataFrame:
    return C.last_months(part_obs(spark, sf), 3, 2)


@query("flt8_date_range", f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {d('l_shipdate', 'l_shipdate')}, {r('l_quantity')} FROM lineitem
 WHERE l_shipdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-30'""")
def _range(spark: Spark, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return C.date_range(lines, "1998-03-01", "1998-06-30", "l_shipdate").withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("flt9_outside", f"""WITH {_NUM} SELECT event_id, coalesce(NOT (value BETWEEN 2.0 AND 60.0), true) AS outside FROM num""")
def _outside(spark: Spark, sf: str) -> DataFrame:
    return dirty(spark, sf).select("event_id", C.outside(C.to_number(q("value")), 2.0, 60.0).alias("outside"))


# --- joins ---------------------------------------------------------------------------

def _member(spark: Spark, sf: str, series: str, name: str) -> DataFrame:
    return obs(spark, sf).filter(q("series_id") == series).select("date", F.col("value").alias(name))


_OTHERS = [(s, c) for s, c in PRIORITIES.items() if c != "urgent"]


@query("jon1_spine_chain", f"""WITH {OBS}, u AS (SELECT date, value AS urgent FROM obs WHERE series_id = '1-URGENT')
 SELECT {d('u.date')}, {r('urgent')}, {', '.join(r(f'o_{c}.value', c) for _, c in _OTHERS)} FROM u
 {' '.join(f"LEFT JOIN obs o_{c} ON o_{c}.date = u.date AND o_{c}.series_id = '{s}'" for s, c in _OTHERS)}""")
def _spine(spark: Spark, sf: str) -> DataFrame:
    return J.join_on_spine(_member(spark, sf, "1-URGENT", "urgent"), [_member(spark, sf, s, c) for s, c in _OTHERS])


@query("jon1_pivot", f"WITH {PANEL} SELECT {d()}, {', '.join(r(c) for c in MEMBERS)} FROM panel")
def _pivot(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf)


@query("jon2_inner_on_date", f"""WITH {PANEL}, {PART_OBS.replace('obs AS', 'pobs AS')}
 SELECT p.series_id, {d('p.date')}, {r('p.value', 'value')}, {', '.join(r(c) for c in MEMBERS)} FROM pobs p JOIN panel o ON o.date = p.date""")
def _inner(spark: Spark, sf: str) -> DataFrame:
    return J.inner_on_date(part_obs(spark, sf), panel(spark, sf))


@query("jon3_suffixes", f"""WITH {OBS} SELECT a.series_id, {d('a.date')}, {r('a.value', 'value_x')}, {r('b.value', 'value_y')}
 FROM obs a JOIN obs b ON b.series_id = a.series_id AND b.date + INTERVAL 12 MONTH = a.date""")
def _suffixes(spark: Spark, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return J.join_suffixed(o, o.withColumn("date", F.add_months("date", 12)), ["series_id", "date"])


PAIRS_SQL = """pairs AS (SELECT series_id, date, value AS actual,
 lag(value, 1) OVER (PARTITION BY series_id ORDER BY date) AS forecast FROM obs)"""


@query("jon4_align_forecast", f"""WITH {PART_OBS}, {PAIRS_SQL} SELECT series_id, {d()}, {r('actual')}, {r('forecast')}
 FROM pairs WHERE forecast IS NOT NULL""")
def _align(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    naive = W.lags(o, [1]).select("series_id", "date", F.col("value_lag1").alias("value")).filter("value is not null")
    return J.align_forecast(o, naive)


@query("jon5_concat_columns", f"""WITH {PART_OBS}, x AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS p,
 FROM obs) SELECT series_id, {d()}, {r('value')}, {r('value - p', 'change')} FROM x""")
def _concat(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    change = W.differences(o, [1], False).select("series_id", "date", F.col("value_diff1").alias("change"))
    return J.concat_columns(o, change)


@query("jon6_train_params", f"""WITH {PART_OBS}, p AS (SELECT series_id, avg(value) AS m FROM obs
 WHERE date < DATE '{SPLIT}' GROUP BY 1) SELECT o.series_id, {d()}, {r('value - m', 'gap', 3)}
 FROM obs o LEFT JOIN p ON p.series_id = o.series_id WHERE date >= DATE '{SPLIT}'""", 3)
def _with_params(spark: Spark, sf: str) -> DataFrame:
    train, test = C.split_at(part_obs(spark, sf), SPLIT)
    params = train.groupBy("series_id").agg(F.avg("value").alias("m"))
    return J.with_params(test, params).select("series_id", "date", (q("value") - q("m")).alias("gap"))


@query("jon7_grid", f"""WITH {PART_OBS}, n AS (SELECT series_id, count(*) AS n FROM obs GROUP BY 1)
 SELECT series_id, n, p::BIGINT AS p, dd::BIGINT AS d FROM n, (VALUES (0), (1), (2), (3)) a(p), (VALUES (0), (1), (2)) b(dd)""")
def _grid(spark: Spark, sf: str) -> DataFrame:
    counts = part_obs(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return J.with_grid(counts, [{"p": p, "d": dd} for p in range(4) for dd in range(3)])


ROUTING = {"1-URGENT": "prophet", "2-HIGH": "arima", "3-MEDIUM": "prophet", "4-NOT SPECIFIED": "arima", "5-LOW": "prophet"}


@query("jon8_route_models", f"""WITH {OBS}, w AS (SELECT series_id, date, value AS actual,
 lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 6) OVER w AS l6, lag(value, 12) OVER w AS l12
 FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY date))
 SELECT series_id, {d()}, {r('actual')}, {r("coalesce(CASE WHEN series_id IN ('1-URGENT','3-MEDIUM','5-LOW') THEN coalesce(l12, l6) END, l2, l1, l6)", 'forecast')} FROM w""")
def _route(spark: Spark, sf: str) -> DataFrame:
    x = W.lags(obs(spark, sf), [1, 2, 6, 12])
    base = x.select("series_id", "date", q("value").alias("actual"), q("value_lag2").alias("hybrid"), q("value_lag1").alias("arima"))
    other = x.select("series_id", "date", q("value_lag12").alias("hybrid"), q("value_lag6").alias("prophet"))
    return J.route_models(base, other, ROUTING)


CURVE_NAMES = {"urgent": "1-Month Rate", "high": "3-Month Rate", "medium": "6-Month Rate",
               "unspecified": "10-Year Rate", "low": "30-Year Rate"}


def _curve(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("date", *[(q(c) / 1e6).alias(n) for c, n in CURVE_NAMES.items()])


_INV = " ".join(f"WHEN {s} <> 0 AND {l} <> 0 AND {s} > {l} THEN '{CURVE_NAMES[s].replace(' Rate', '')} > {CURVE_NAMES[l].replace(' Rate', '')}'"
                for s in ("urgent", "high", "medium") for l in ("unspecified", "low"))


@query("jon9_inversion", f"WITH {PANEL} SELECT {d()}, CASE {_INV} END AS inversion FROM panel")
def _inversion(spark: Spark, sf: str) -> DataFrame:
    return _curve(spark, sf).select("date", S.curve_inversion().alias("inversion"))


@query("jon10_candidates", f"""WITH {ECONOMY} SELECT series_id, {d()},
 {', '.join(r(f'"{[c for c in cands if c in INDICATORS][0]}"', f'"{label}"') for label, cands in LABEL_CANDIDATES.items())} FROM econ""")
def _candidates(spark: Spark, sf: str) -> DataFrame:
    return S.label_values(economy(spark, sf))


# --- sets ------------------------------------------------------------------------------

@query("set1_stack", f"""WITH {PART_OBS} SELECT series_id, {d()}, {r('value')}, NULL::DOUBLE AS forecast, 'history' AS source FROM obs
 UNION ALL SELECT series_id, strftime(max(date) + INTERVAL 1 MONTH, '%Y-%m-%d'), NULL, round(arg_max(value, date), 4), 'forecast'
 FROM obs GROUP BY series_id""")
def _stack(spark: Spark, sf: str) -> DataFrame:
    o = part_obs(spark, sf)
    ahead = J.repeat_last(o, 1).select("series_id", "date", q("value").alias("forecast"))
    return J.stack({"history": o, "forecast": ahead})


@query("set2_append", f"""WITH {PANEL} SELECT {d()}, {r('urgent')}, {r('high')} FROM panel
 UNION ALL SELECT strftime(max(date) + INTERVAL 1 MONTH, '%Y-%m-%d'), round(avg(urgent), 4), NULL FROM panel""")
def _append(spark: Spark, sf: str) -> DataFrame:
    p = panel(spark, sf).select("date", "urgent", "high")
    extra = p.agg(F.add_months(F.max("date"), 1).alias("date"), F.avg("urgent").alias("urgent"))
    return J.append_rows(p, extra)


@query("set3_repeat_last", f"""WITH {PART_OBS}, l AS (SELECT series_id, max(date) AS date, arg_max(value, date) AS value FROM obs GROUP BY 1)
 SELECT series_id, strftime(date + to_months(step::INTEGER), '%Y-%m-%d') AS date, {r('value')}, step FROM l, range(1, 4) t(step)""")
def _repeat(spark: Spark, sf: str) -> DataFrame:
    return J.repeat_last(part_obs(spark, sf), 3)


@query("set4_lengthen", f"WITH {PANEL} " + " UNION ALL ".join(
    f"SELECT {d()}, '{c}' AS series_id, {r(c, 'value')} FROM panel" for c in MEMBERS))
def _lengthen(spark: Spark, sf: str) -> DataFrame:
    return J.lengthen(panel(spark, sf), MEMBERS)


@query("set5_feature_union", f"""WITH f AS (SELECT l_returnflag AS target, l_suppkey AS feature FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) / count(*) > 25.5)
 SELECT feature, count(*) AS n_targets, count(*) = (SELECT count(DISTINCT target) FROM f) AS in_all FROM f GROUP BY 1""")
def _union(spark: Spark, sf: str) -> DataFrame:
    rows = (table(spark, sf, "lineitem").groupBy(q("l_returnflag").alias("target"), q("l_suppkey").alias("feature"))
            .agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("score")).filter("score > 25.5"))
    return J.feature_union(rows)


# --- top-k -------------------------------------------------------------------------------

@query("top1_sorted", f"WITH {PART_OBS} SELECT series_id, {d()}, {r('value')} FROM obs ORDER BY date, series_id")
def _sorted(spark: Spark, sf: str) -> DataFrame:
    return part_obs(spark, sf).orderBy("date", "series_id")


@query("top2_last_row", f"""WITH {PART_OBS} SELECT series_id, {d('max(date)')}, {r('arg_max(value, date)', 'value')} FROM obs GROUP BY 1""")
def _last(spark: Spark, sf: str) -> DataFrame:
    return J.last_row(part_obs(spark, sf))


@query("top3_tail", f"""WITH {PART_OBS}, x AS (SELECT *, row_number() OVER
 (PARTITION BY series_id ORDER BY date DESC) AS rn FROM obs) SELECT series_id, {d()}, {r('value')} FROM x WHERE rn <= 10""")
def _tail10(spark: Spark, sf: str) -> DataFrame:
    return C.last_points(part_obs(spark, sf), 10)


@query("top4_top_features", f"""WITH {PART_OBS} SELECT series_id AS feature, {r('sum(value)', 'score', 2)} FROM obs
 GROUP BY 1 ORDER BY round(sum(value), 2) DESC, series_id LIMIT 40""", 2)
def _topk(spark: Spark, sf: str) -> DataFrame:
    scores = part_obs(spark, sf).groupBy(q("series_id").alias("feature")).agg(F.round(F.sum("value"), 2).alias("score"))
    return A.top_features(scores, 40)


@query("top5_best_config", f"""WITH {PART_OBS}, x AS (SELECT *, row_number() OVER
 (PARTITION BY series_id ORDER BY value, date) AS rn FROM obs) SELECT series_id, {d()}, {r('value')} FROM x WHERE rn = 1""")
def _best(spark: Spark, sf: str) -> DataFrame:
    return A.best_config(part_obs(spark, sf), "value", ties=["date"])


# --- scalar functions -----------------------------------------------------------------------

@query("fun1_calendar", """SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
 CAST(year(o_orderdate) AS BIGINT) AS year, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year FROM orders""")
def _fields(spark: Spark, sf: str) -> DataFrame:
    return S.calendar_fields(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("fun2_month_floor", f"SELECT event_id, {d('date_trunc($$month$$, ts)', 'month').replace('$$', chr(39))} FROM events")
def _floor(spark: Spark, sf: str) -> DataFrame:
    return event_obs(spark, sf).select("event_id", S.month_floor(q("date")).alias("month"))


@query("fun3_labels", """SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS business_quarter, monthname(o_orderdate) AS month FROM orders""")
def _labels(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", S.quarter_label(q("o_orderdate")).alias("business_quarter"),
                                             S.month_name(q("o_orderdate")).alias("month"))


@query("fun4_future_dates", f"""WITH {PART_OBS}, l AS (SELECT series_id, max(date) AS last FROM obs GROUP BY 1)
 SELECT series_id, step, strftime(last_day(last + to_months(step::INTEGER)), '%Y-%m-%d') AS date,
 CAST((2001 - year(last)) * 12 + 12 - month(last) AS BIGINT) AS months FROM l, range(1, 5) t(step)""")
def _future(spark: Spark, sf: str) -> DataFrame:
    last = part_obs(spark, sf).groupBy("series_id").agg(F.max("date").alias("date"))
    last = last.withColumn("months", S.months_ahead(q("date"), F.lit("2001-12-15").cast("date")))
    return S.future_dates(last, 4)


_FOURIER = [(g, p, k) for g, (n, p) in (("monthly", (6, 12)), ("quarterly", (2, 4)), ("business", (3, 48)), ("longterm", (2, 120)))
            for k in range(1, n + 1)]


@query("fun5_fourier", f"""WITH {OBS}, s AS (SELECT min(date) AS start FROM obs) SELECT series_id, {d()}, """ + ", ".join(
    r(f"{fn}(2 * pi() * {k} / {p}.0::DOUBLE * (date_diff('day', start, date) / (365.25::DOUBLE / {p})))", f"fourier_{g}_{fn}_{k}")
    for g, p, k in _FOURIER for fn in ("sin", "cos")) + " FROM obs, s")
def _fourier(spark: Spark, sf: str) -> DataFrame:
    o = obs(spark, sf)
    start = F.lit(o.agg(F.min("date")).first()[0])  # reference date of all series: one scalar
    terms = {n: c for g in ("monthly", "quarterly", "business", "longterm")
             for n, c in S.fourier_terms(q("date"), start, g).items()}
    return o.select("series_id", "date", *[c.alias(n) for n, c in terms.items()])


_SHARE = "least(greatest(l_discount * 10, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
_TIGHT = "least(greatest(least(greatest(l_tax * 1300, 0), 100) / 100.0::DOUBLE, 1e-8::DOUBLE), 1 - 1e-8::DOUBLE)"


@query("fun6_logit", f"""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
 ln({_SHARE} / (1 - {_SHARE})) AS a, ln({_TIGHT} / (1 - {_TIGHT})) AS b FROM lineitem)
 SELECT l_orderkey, l_partkey, l_linenumber, {r('a', 'logit')}, {r('100 / (1 + exp(-a))', 'back')}, {r('b', 'safe')},
 {r('least(greatest(100 / (1 + exp(-least(greatest(b, -50), 50))), 0), 100)', 'safe_back')} FROM x""")
def _logit(spark: Spark, sf: str) -> DataFrame:
    a, b = S.logit(q("l_discount") * 10 * 100), S.safe_logit(q("l_tax") * 1300)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", a.alias("logit"), S.inverse_logit(a).alias("back"), b.alias("safe"),
        S.safe_inverse_logit(b).alias("safe_back"))


@query("fun7_box_cox", f"""WITH {PART_OBS}, x AS (SELECT *, value / 1000 AS v, CASE series_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5 ELSE -0.5 END AS lam FROM obs),
 y AS (SELECT *, CASE WHEN lam = 0 THEN ln(v + 1) ELSE (pow(v + 1, lam) - 1) / lam END AS t FROM x)
 SELECT series_id, {d()}, {r('t', 'transformed')}, {r('CASE WHEN lam = 0 THEN exp(t) ELSE pow(t * lam + 1, 1 / lam) END - 1', 'back')} FROM y""")
def _boxcox(spark: Spark, sf: str) -> DataFrame:
    lam = F.when(q("series_id") % 3 == 0, 0.0).when(q("series_id") % 3 == 1, 0.5).otherwise(-0.5)
    t = S.box_cox(q("value") / 1000, lam, 1.0)
    return part_obs(spark, sf).select("series_id", "date", t.alias("transformed"), S.inverse_box_cox(t, lam, 1.0).alias("back"))


@query("fun8_interactions", f"""WITH {ECONOMY} SELECT series_id, {d()}, {r('"CPI" * "unemployment_rate"', 'CPI_unemployment_interaction')},
 {r('"INDPRO" / ("CPI" + 1e-6::DOUBLE)', 'INDPRO_CPI_ratio')}, {r('"share_price" / ("gdp_per_capita" + 1e-6::DOUBLE)', 'share_gdp_ratio')},
 {r('"PPI" - "CPI"', 'PPI_CPI_diff')}, {r('"10_year_rate" - "3_months_rate"', 'interest_spread')} FROM econ""")
def _interact(spark: Spark, sf: str) -> DataFrame:
    return S.interactions(economy(spark, sf)).select(
        "series_id", "date", "CPI_unemployment_interaction", "INDPRO_CPI_ratio", "share_gdp_ratio", "PPI_CPI_diff", "interest_spread")


@query("fun9_clip", f"""SELECT event_id, {r('least(greatest(value * 2 - 10, 0), 100)', 'percent')},
 {r('least(greatest((value * 2 - 10) / 100, 0), 1)', 'share')} FROM events""")
def _clip(spark: Spark, sf: str) -> DataFrame:
    v = q("value") * 2 - 10
    return event_obs(spark, sf).select("event_id", S.clip(v, 0.0, 100.0).alias("percent"), S.percent_to_share(v).alias("share"))


@query("fun10_bands", """SELECT event_id, CASE WHEN round(value, 1) >= 70 THEN 'High Risk' WHEN round(value, 1) >= 50 THEN 'Moderate Risk'
 WHEN round(value, 1) >= 30 THEN 'Elevated Risk' ELSE 'Low Risk' END AS risk, CASE WHEN value / 100 < 0.3 THEN 'low' WHEN value / 100 < 0.6 THEN 'medium' ELSE 'high' END AS card,
 CASE WHEN value < 5 THEN 'Good' WHEN value < 15 THEN 'Fair' ELSE 'Poor' END AS grade FROM events""")
def _bands(spark: Spark, sf: str) -> DataFrame:
    return event_obs(spark, sf).select("event_id", S.risk_level(q("value")).alias("risk"),
                                       S.card_level(q("value") / 100).alias("card"), S.forecast_grade(q("value")).alias("grade"))


_ENDS = ", ".join(MEMBERS)


@query("fun11_steepness", f"""WITH {PANEL}, x AS (SELECT date, (coalesce({', '.join(reversed(MEMBERS))}) - coalesce({_ENDS})) / 1e6::DOUBLE AS s,
 {' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in MEMBERS)} AS n FROM panel), y AS (SELECT date, CASE WHEN n >= 2 THEN s END AS s FROM x)
 SELECT {d()}, {r('s', 'steepness')}, CASE WHEN s > 1.5 THEN 'steep' WHEN s < -0.5 THEN 'deeply inverted' WHEN s > 0 THEN 'normal'
 WHEN s IS NOT NULL THEN 'flat' END AS class FROM y""")
def _steep(spark: Spark, sf: str) -> DataFrame:
    s = S.steepness([q(n) for n in CURVE_NAMES.values()])
    return _curve(spark, sf).select("date", s.alias("steepness"), S.steepness_class(s).alias("class"))


@query("fun12_spread", f"""WITH {PANEL} SELECT {d()}, round((unspecified - high) / 1e6::DOUBLE, 2) + 0 AS spread,
 high > unspecified AS inverted FROM panel""")
def _spread(spark: Spark, sf: str) -> DataFrame:
    c = _curve(spark, sf)
    short, long = q("3-Month Rate"), q("10-Year Rate")
    return c.select("date", S.spread(short, long).alias("spread"), (short > long).alias("inverted"))


@query("fun13_log", f"""SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, {r('ln(nullif(l_discount, 0))', 'log_discount')},
 {r('exp(ln(nullif(l_discount, 0)))', 'back')} FROM lineitem""")
def _log(spark: Spark, sf: str) -> DataFrame:
    x = S.log_positive(q("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", x.alias("log_discount"), F.exp(x).alias("back"))


@query("fun14_label_codes", f"""WITH p AS (SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#13'), 'Unknown') AS p_brand, p_size FROM part),
 c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM p WHERE p_size <= 40))
 SELECT p_partkey, p.p_brand, coalesce(code, 0) AS p_brand_code FROM p LEFT JOIN c USING (p_brand)""")
def _codes(spark: Spark, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", F.nullif(q("p_brand"), F.lit("Brand#13")).alias("p_brand"))
    # Codes are learned from the smaller parts and applied to all.
    codes = S.label_codes(parts.filter("p_size <= 40"), "p_brand")
    return S.encode_labels(parts.drop("p_size"), codes, "p_brand")


@query("fun15_input_labels", f"""WITH {PANEL} SELECT {d()}, {r('urgent', '"CPI"')}, {r('high', '"INDPRO"')} FROM panel""")
def _inputs(spark: Spark, sf: str) -> DataFrame:
    given = panel(spark, sf).select("date", q("urgent").alias("CPI"), q("high").alias("Industrial Production"))
    return S.from_labels(given, {"CPI": "CPI", "Industrial Production": "INDPRO"}, "date")


@query("udf2_flag", "SELECT event_id, CASE WHEN value > 10 AND value < 20 THEN 1 ELSE 0 END::BIGINT AS hit FROM events")
def _flag(spark: Spark, sf: str) -> DataFrame:
    return S.flag(event_obs(spark, sf), "value", lambda c: (c > 10) & (c < 20), "hit").select("event_id", "hit")
