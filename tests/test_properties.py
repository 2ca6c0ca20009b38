"""Properties and hand-made results of operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrospark.functions import scalar as S
from macrospark.operators import blocks as B, clean as C, decompose as D, forecast as T, joins as J, quantiles as Q
from macrospark.operators import quality as DQ, stats as A, windows as W
from macrospark.plans import pipelines as P


def values(df, column="value", by=("series_id", "date")):
    return [r[column] for r in df.orderBy(*by).collect()]


def wave(n, slope=0.5, noise=0.0, seed=0):
    t = np.arange(n)
    return 100 + slope * t + 10 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(seed).normal(0, noise, n)


def test_upsampling_matches_known_quarters(spark):
    rows = [("g", dt.date(1967, 1, 1), 24602.0), ("g", dt.date(1967, 4, 1), 24556.0)]
    out = values(W.upsample_monthly(spark.createDataFrame(rows, "series_id string, date date, value double")))
    assert np.allclose(out, [24602.0, 24586.666667, 24571.333333, 24556.0])


def test_interpolation_ends(series):
    df = series({"a": [None, 1.0, None, 3.0, None, None]})
    assert values(W.interpolate(df)) == [None, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert values(W.interpolate_full(df)) == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]


def test_fill_stays_in_year(series):
    df = series({"a": [None, 1.0, *[None] * 11, 2.0]}, "2000-06-01")
    out = values(W.fill_within_year(df))
    assert out[0] == 1.0 and out[6] == 1.0 and out[7] == 2.0


def test_percent_change_of_zero_is_null(series):
    assert values(W.percent_change(series({"a": [0.0, 2.0, None, 3.0]})), "value_pct_change1") == [None, None, 0.0, 0.5]


def test_rolling_excludes_current_row(series):
    out = values(W.rolling_previous(series({"a": [1.0, 2.0, 3.0, 1000.0]}), [3], ["mean"]), "value_rollmean3")
    assert out == [None, None, None, 2.0]


def test_undo_differencing(series):
    v = list(wave(30, noise=2.0))
    df = W.time_index(series({"a": v, "b": v[::-1]}))
    second = W.differences(df, []).filter("t >= 2").select("series_id", "date", F.col("value_second_diff").alias("value"))
    out = W.undo_differencing(second, W.last_levels(df.filter("t < 2"), 2), 2)
    assert np.allclose(values(out), v[2:] + v[::-1][2:])


def test_expanding_acf_last_row_equals_whole(series):
    df = series({"a": list(wave(40, noise=3.0)), "b": list(wave(25, noise=5.0, seed=2))})
    last = {r["series_id"]: r for r in J.last_row(W.expanding_acf(df)).collect()}
    for r in W.acf_features(df).collect():
        for f in ("original", "diff1", "diff2"):
            assert last[r["series_id"]][f"acf1_{f}"] == pytest.approx(r[f"first_acf_{f}"])
            assert last[r["series_id"]][f"sumsq_acf_{f}"] == pytest.approx(r[f"sumsq_acf_{f}"])


def test_acf_needs_history(series):
    assert W.acf_features(series({"a": [1.0, 2.0] * 7})).count() == 0


@pytest.mark.parametrize("span", [1, 3, 12, 200])
def test_ema_matches_pandas(series, span):
    v = wave(300, noise=5.0)
    out = values(B.ema(series({"a": v}), span, "date", output="e"), "e")
    assert np.allclose(out, pd.Series(v).ewm(span=span, adjust=False).mean())


# --- blocks ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # Two thirds of all rows belong to one series, and its days differ much in size.
    pdf = pd.DataFrame({"series_id": rng.choice(["hot", "b", "c"], n, p=[0.66, 0.3, 0.04]), "n": np.arange(n),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta((rng.beta(1, 6, n) * 40 * 86400).round(), "s"),
                        "value": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.3, "value"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None, ["value"])
    return B.add_block(df, "ts", "day"), pdf.sort_values(["series_id", "ts", "n"]).reset_index(drop=True)


def lined_up(df, column):
    return df.toPandas().sort_values(["series_id", "ts", "n"])[column].to_numpy(dtype=float)


AT = ["ts", "n"]


def test_blocked_operators_match_pandas(ticks):
    df, pdf = ticks
    g = pdf.groupby("series_id")["value"]
    assert (lined_up(B.row_index(df, AT), "t") == g.cumcount()).all()
    assert np.allclose(lined_up(B.forward_fill(df, AT), "value"), g.ffill(), equal_nan=True)
    assert np.allclose(lined_up(B.backward_fill(df, AT), "value"), g.bfill(), equal_nan=True)
    filled = pdf.assign(value=pdf["value"].fillna(0.0)).groupby("series_id")["value"]
    zero = df.na.fill(0.0, ["value"])
    assert np.allclose(lined_up(B.running_sum(zero, AT), "running_sum"), filled.cumsum())
    got = lined_up(B.ema(zero, 9, AT, block="block", size=32), "value_ema9")
    assert np.allclose(got, filled.transform(lambda s: s.ewm(span=9, adjust=False).mean()))


def test_border_rows_reach_over_short_blocks(ticks):
    df, pdf = ticks
    g = pdf.assign(value=pdf["value"].fillna(0.0)).groupby("series_id")["value"]
    hours = B.add_block(df.na.fill(0.0, ["value"]), "ts", "hour")
    back = B.in_blocks(hours, lambda x, k: W.lags(x, [15], k, AT), AT, earlier=15)
    assert back.count() == len(pdf)
    assert np.allclose(lined_up(back, "value_lag15"), g.shift(15), equal_nan=True)
    ahead = B.in_blocks(hours, lambda x, k: W.horizon_targets(x, [6], k, AT), AT, later=6)
    assert np.allclose(lined_up(ahead, "value_lead6"), g.shift(-6), equal_nan=True)


def test_range_blocks_are_even(ticks):
    df, pdf = ticks
    ranged = B.add_range_block(df.drop("block"), "ts", 40)
    assert ranged.groupBy("block").count().agg(F.max("count")).first()[0] <= 1.5 * len(pdf) / 40
    assert (lined_up(B.row_index(ranged, AT), "t") == pdf.groupby("series_id").cumcount()).all()


def test_exponential_means_in_groups(ticks, monkeypatch):
    df, pdf = ticks
    monkeypatch.setattr(B, "GROUP", 4)
    zero = B.add_range_block(df.drop("block").na.fill(0.0, ["value"]), "ts", 40)
    filled = pdf.assign(value=pdf["value"].fillna(0.0)).groupby("series_id")["value"]
    got = B.ema(zero, [1, 9, 60], AT, block="block", size=16)
    for span in (1, 9, 60):
        assert np.allclose(lined_up(got, f"value_ema{span}"), filled.transform(lambda s: s.ewm(span=span, adjust=False).mean()))


@pytest.mark.parametrize("kind", ["normal", "ties", "zeros"])
@pytest.mark.parametrize("n", [1, 2, 101, 5000])
def test_exact_quantiles(spark, kind, n):
    rng = np.random.default_rng(n)
    v = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float),
         "zeros": np.r_[np.zeros(n // 2), rng.exponential(size=n - n // 2)]}[kind]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    row = Q.exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})).repartition(3), "v", probs, accuracy=100).first()
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], np.quantile(v, probs))


# --- decomposition -----------------------------------------------------------------------

def test_decomposition_adds_up(series):
    df = D.decompose(series({"a": wave(60, noise=1.0), "short": wave(20)}))
    rows = {k: v for k, v in df.toPandas().groupby("series_id")}
    a = rows["a"]
    assert np.allclose(a["trend"] + a["seasonal"] + a["residual"], a["value"])
    assert a.sort_values("date")["seasonal"][:12].sum() == pytest.approx(0, abs=1e-9)
    assert rows["short"]["trend"].isna().all()


@pytest.mark.parametrize("robust", [False, True])
def test_loess_decomposition(robust):
    y = wave(120, noise=0.5)
    if robust:
        y[60] += 100
    seasonal, trend = D.stl_arrays(y, robust=robust)
    t = np.arange(120)
    assert np.abs(trend - (100 + 0.5 * t)).max() < 1.0
    assert np.abs(seasonal - 10 * np.sin(2 * np.pi * t / 12)).max() < 1.5


def test_multiplicative_parts(series):
    df = D.decompose_multiplicative(series({"a": wave(48)})).toPandas()
    assert np.allclose(df["trend"] * df["seasonal"] * df["residual"], df["value"])
    assert np.allclose(df["adjusted"] * df["seasonal"], df["value"])


def test_test_rows_do_not_change_train_parameters(series):
    v = wave(60, noise=1.0)
    changed = v.copy()
    changed[48:] *= 5
    first = P.leak_free_features(series({"a": v}), "2004-01-01")
    second = P.leak_free_features(series({"a": changed}), "2004-01-01")
    for name in ("decomposition", "bounds", "acf"):
        assert getattr(first, name).collect() == getattr(second, name).collect()
    rows = second.rows.filter("source = 'test'").toPandas()
    assert rows["trend"].nunique() == 1 and rows["anomaly"].sum() > 0


def test_short_series_forecast_parts(series):
    history = series({"a": [1.0, 2.0]})
    ahead = series({"a": [4.0, 6.0]}, "2000-03-01")
    out = D.decompose_forecast(history, ahead).orderBy("date").collect()
    assert [r["trend"] for r in out] == [5.0, 5.0] and [r["residual"] for r in out] == [-1.0, 1.0]


def test_static_bounds_flag_missing_values(spark, series):
    bounds = spark.createDataFrame([("a", 0.0, 10.0)], "series_id string, lower_bound double, upper_bound double")
    assert values(D.flag_values(series({"a": [1.0, None, 11.0]}), bounds), "anomaly") == [0, 1, 1]


# --- scalar functions ----------------------------------------------------------------------

def test_inverse_transforms(spark):
    df = spark.range(1, 100).select(F.col("id").cast("double").alias("x"))
    for back in (S.inverse_logit(S.logit(F.col("x"))), S.safe_inverse_logit(S.safe_logit(F.col("x"))),
                 S.inverse_box_cox(S.box_cox(F.col("x"), 0.3, 2.0), 0.3, 2.0),
                 S.inverse_box_cox(S.box_cox(F.col("x"), 0.0), 0.0)):
        assert df.agg(F.max(F.abs(back - F.col("x")))).first()[0] < 1e-6


def test_logit_clips(spark):
    row = spark.range(1).select(S.safe_inverse_logit(S.safe_logit(F.lit(-5.0))).alias("lo"),
                                S.safe_inverse_logit(S.safe_logit(F.lit(500.0))).alias("hi"),
                                S.logit(F.lit(None).cast("double")).alias("none")).first()
    assert row["lo"] == pytest.approx(0, abs=1e-5) and row["hi"] == pytest.approx(100, abs=1e-5) and row["none"] is None


def test_inversion_order_and_missing_tenors(spark):
    cols = ["1-Month Rate", "3-Month Rate", "6-Month Rate", "10-Year Rate", "30-Year Rate"]
    rows = [(None, 5.0, 5.0, 4.0, 6.0), (1.0, 1.0, 1.0, 2.0, 2.0), (9.0, 0.0, 0.0, None, 3.0)]
    schema = ", ".join(f"`{c}` double" for c in cols)
    out = [r[0] for r in spark.createDataFrame(rows, schema).select(S.curve_inversion()).collect()]
    assert out == ["3-Month > 10-Year", None, "1-Month > 30-Year"]


def test_month_end_dates(spark):
    last = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "series_id string, date date")
    assert [r["date"] for r in S.future_dates(last, 2).orderBy("step").collect()] == [dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert S.future_dates(last, 1, anchor="start").first()["date"] == dt.date(2024, 2, 1)


# --- statistics and quality ------------------------------------------------------------------

def test_mape_variants(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (-4.0, -3.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    row = df.agg(*[A.mape(y, p, v).alias(v) for v in ("skip_zero", "null_zero", "floor", "at_least_one")]).first()
    assert row["skip_zero"] == pytest.approx(37.5) and row["null_zero"] == pytest.approx(37.5)
    assert row["at_least_one"] == pytest.approx((1 + 0.5 + 1) / 3 * 100)
    assert row["floor"] == pytest.approx((1e8 + 0.5 + 0.25) / 3 * 100)
    with pytest.raises(ValueError):
        A.mape(y, p, "other")


def test_maximum_has_its_own_bin(spark):
    df = spark.range(1, 9).select(F.col("id").cast("double").alias("v"))
    bins = [r["bin"] for r in A.quartile_bins(df, "v").orderBy("v").collect()]
    assert bins == list(np.digitize(np.arange(1, 9), np.quantile(np.arange(1, 9), [0, 0.25, 0.5, 0.75, 1])) - 1)


def test_malformed_payload(spark):
    rows = [("2020-01-01", "100.5"), ("invalid-date", "1"), ("2020-03-01", "."), ("2020-04-01", ""),
            ("2020-05-01", "inf"), (None, "2"), ("2020-07-01", "-999"), ("2020-08-01", None)]
    parsed = DQ.parse_records(spark.createDataFrame(rows, "date string, value string"))
    reasons = [r["reject_reason"] for r in parsed.collect()]
    assert reasons == [None, "bad_date", "missing_token", "empty_value", "non_finite", "missing_date", "sentinel", "missing_value"]
    assert parsed.count() == len(rows) and parsed.agg(F.count("parsed_value")).first()[0] == 3


def test_split_and_outside(series):
    df = series({"a": list(range(10)), "b": [1.0] * 4})
    marked = C.split_tail(df, 0.25)
    assert marked.filter("is_test").groupBy("series_id").count().orderBy("series_id").collect()[0]["count"] == 2
    assert C.varying_series(df, df).select("series_id").distinct().collect()[0][0] == "a"


def test_steep_means_and_odd_spans(series):
    df = series({"a": [float(i % 7) for i in range(300)]})
    got = [r[0] for r in B.ema(df, 1.003, "date").orderBy("date").select("`value_ema1.003`").collect()]
    want, alpha = 0.0, 2 / 2.003
    for i, x in enumerate(got):
        want = (i % 7) if i == 0 else alpha * (i % 7) + (1 - alpha) * want
        assert x == pytest.approx(want)


def test_quantiles_leave_raw_rows_in_place(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 5000).cast("double").alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole = plan(Q.exact_quantiles(rows, "v", [0.5], accuracy=100))
    assert "rightHint=(strategy=broadcast)" in whole and "leftHint" not in whole
    got = {r["k"]: r["q0"] for r in Q.exact_quantiles(rows, "v", [0.5], ["k"], accuracy=100).collect()}
    want = rows.toPandas().groupby("k")["v"].median().to_dict()
    assert got == want


# --- forecasting -------------------------------------------------------------------------------

def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, series_id="s")
    fit = T.least_squares(spark.createDataFrame(pdf), ["a", "b", "c"], "y").first()
    want, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    assert np.allclose(fit["coef"], want)


def test_auto_forecast_recovers_process(series):
    rng = np.random.default_rng(0)
    v = [0.0]
    for _ in range(400):
        v.append(5 + 0.8 * v[-1] + rng.normal(0, 0.5))
    out = T.lag_model_forecast(series({"a": v[50:]}), 24).orderBy("step").collect()
    assert out[0]["model"].startswith("d0")
    assert out[-1]["forecast"] == pytest.approx(25, abs=1.5)
    assert out[0]["lower"] < out[0]["forecast"] < out[0]["upper"]
    assert out[-1]["upper"] - out[-1]["lower"] > out[0]["upper"] - out[0]["lower"]


def test_ar1_equals_grid_fit(series):
    df = series({"a": wave(60, noise=2.0)})
    plain = T.ar1_forecast(df, 5).orderBy("step").collect()
    grid = T.lag_model_forecast(df, 5, [T.LagModel(0, (1,))]).orderBy("step").collect()
    assert np.allclose([r["forecast"] for r in plain], [r["forecast"] for r in grid])


def test_seasonal_model_falls_back(series):
    out = T.lag_model_forecast(series({"long": wave(60, noise=0.3), "short": [1.0, 2.0, 4.0, 3.0, 6.0, 5.0, 7.0, 9.0], "one": [3.0]}),
                               12, T.SEASONAL_ORDER, pick="first")
    models = {r["series_id"]: r["model"] for r in out.collect()}
    assert models == {"long": "d1_lags1_12", "short": "last_value", "one": "last_value"}
    assert out.count() == 36


def test_trend_forecast_fallbacks(series):
    out = T.trend_forecast(series({"line": [1.0, 2.0, 3.0], "two": [5.0, 7.0], "none": [None, None]}), 2)
    got = {(r["series_id"], r["step"]): r["forecast"] for r in out.collect()}
    assert got[("line", 2)] == pytest.approx(5.0) and got[("two", 1)] == 7.0 and got[("none", 1)] == 0.0


def test_vector_forecast_follows_system(spark):
    a = np.array([[0.6, 0.3], [0.1, 0.7]])
    x = [np.array([10.0, 5.0])]
    rng = np.random.default_rng(1)
    for _ in range(150):
        x.append(np.array([2.0, 1.0]) + a @ x[-1] + rng.normal(0, 1e-3, 2))
    pdf = pd.DataFrame(x, columns=["u", "v"]).assign(series_id="s", date=pd.date_range("2000-01-01", periods=151, freq="MS").date)
    out = T.vector_forecast(spark.createDataFrame(pdf), ["u", "v"], 3).orderBy("step").collect()
    want = np.array([2.0, 1.0]) + a @ x[-1]
    assert np.allclose([out[0]["u"], out[0]["v"]], want, atol=0.05)


def test_seasonal_regression(series):
    v = wave(84)
    out = T.seasonal_regression_forecast(series({"a": v[:72]}), 12, pairs=2).orderBy("step").collect()
    assert np.abs(np.array([r["forecast"] for r in out]) - v[72:]).max() < 1.0


def test_differencing_order(series):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300)
    out = {r["series_id"]: r["d"] for r in T.differencing_order(
        series({"level": noise, "walk": np.cumsum(noise) + 0.0, "twice": np.cumsum(np.cumsum(noise))})).collect()}
    assert out["level"] == 0 and out["walk"] == 1 and out["twice"] == 2


def test_box_cox_lambda(series):
    rng = np.random.default_rng(4)
    out = {r["series_id"]: r for r in T.box_cox_lambda(series({
        "log": np.exp(rng.normal(size=400)), "root": rng.normal(10, 1, 400) ** 2, "neg": rng.normal(size=50)})).collect()}
    assert abs(out["log"]["lambda"]) < 0.1 and abs(out["root"]["lambda"] - 0.5) < 0.35
    assert out["neg"]["shift"] > 1


def test_walk_forward_uses_true_context(series):
    v = wave(60)
    scored = T.walk_forward(series({"a": v}), "2004-01-01", (1, 2, 12)).toPandas()
    assert len(scored) == 12 and np.abs(scored["actual"] - scored["forecast"]).max() < 1.0


def test_future_exogenous_rules(series):
    history = series({"a": [1.0, 2.0, None]}).withColumnRenamed("value", "x")
    ahead = series({"a": [9.0]}, "2000-04-01").withColumnRenamed("value", "x")
    out = T.future_exogenous(history, 3, ["x"], ahead).orderBy("step").collect()
    assert [r["x"] for r in out] == [9.0, 2.0, 2.0]


def test_wide_gram_is_gram(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(60, 4)), columns=list("abyz")).assign(k=np.arange(60) % 3)
    pdf.loc[4, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    wide = {r["k"]: r for r in T.wide_gram(df, ["a", "b"], ["y", "z"], "k").collect()}
    for plain in T.gram(df, ["a", "b"], ["y", "z"], "k").collect():
        other = wide[plain["k"]]
        assert plain["n"] == other["n"]
        assert all(np.allclose(plain[c], other[c]) for c in ("xx", "xy", "yy"))


def test_seasonal_regression_interval(spark):
    rng = np.random.default_rng(6)
    months = pd.date_range("2000-01-01", periods=60, freq="MS")
    pdf = pd.DataFrame({"series_id": "a", "date": months.date, "value": np.arange(60) / 12 + rng.normal(size=60)})
    got = T.seasonal_regression_forecast(spark.createDataFrame(pdf), 3, pairs=1).orderBy("step").toPandas()
    t = (months - months[0]).days / 365.25
    x = np.stack([np.ones(60), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)], 1)
    coef, sse = np.linalg.lstsq(x, pdf["value"], rcond=None)[:2]
    ahead = (pd.to_datetime(got["date"]) - months[0]).dt.days / 365.25
    z = np.stack([np.ones(3), ahead, np.sin(2 * np.pi * ahead), np.cos(2 * np.pi * ahead)], 1)
    half = 1.959963984540054 * np.sqrt(sse[0] / 56 * (1 + np.einsum("ij,jk,ik->i", z, np.linalg.inv(x.T @ x), z)))
    assert np.allclose(got["forecast"], z @ coef)
    assert np.allclose(got["upper"] - got["forecast"], half) and np.allclose(got["forecast"] - got["lower"], half)


def test_short_series_have_no_statistic(series):
    df = series({"a": [1.0, 3.0], "b": [2.0, 2.0, 2.0]})
    assert {(r["series_id"], r["t0"]) for r in T.differencing_order(df).collect()} == {("a", None), ("b", None)}
    assert all(r["forecast"] is None for r in T.ar1_forecast(df, 2).collect())
