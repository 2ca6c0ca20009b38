"""Changes of trend, seasonal differencing by test and walk-forward refits against plain computations."""

import datetime as dt

import numpy as np
import pytest

from macrospark.operators import forecast as T, seasonal as SE, trend_changes as TC, walk as WF

LONG = "series_id int, date date, value double"


def month(i):
    return dt.date(2000 + i // 12, 1 + i % 12, 1)


def frame(spark, series):
    return spark.createDataFrame([(s, month(i), None if v is None else float(v)) for s, y in series.items() for i, v in enumerate(y)], LONG)


# --- walk forward ---------------------------------------------------------------------

@pytest.mark.parametrize("within", [None, 30])
def test_refit_by_plain_fits(spark, within):
    rng = np.random.default_rng(1)
    series = {s: 1000 + np.cumsum(rng.normal(size=60)) for s in range(4)}
    holes = [None if i in (20, 45) else v for i, v in enumerate(series[3])]
    got = {(r["series_id"], r["date"]): r for r in WF.walk_forward_refit(frame(spark, {**series, 3: holes, 8: [5.0] * 50, 9: [1.0, 2.0]}), "2003-01-01", (1, 3), within).collect()}
    for s in range(4):
        y = np.array([np.nan if v is None else v for v in (holes if s == 3 else series[s])])
        lagged = np.column_stack([np.ones(60), *[np.concatenate([np.full(k, np.nan), y[:-k]]) for k in (1, 3)]])
        for t in range(36, 60):
            past = np.arange(0 if within is None else t - within, t)
            past = past[np.isfinite(lagged[past]).all(axis=1) & np.isfinite(y[past])]
            r = got[s, month(t)]
            assert r["n"] == len(past)
            if np.isfinite(lagged[t]).all():
                coef = np.linalg.lstsq(lagged[past] - [0, 1000, 1000], y[past] - 1000, rcond=None)[0]
                assert r["forecast"] == pytest.approx((lagged[t] - [0, 1000, 1000]) @ coef + 1000, abs=1e-6)
            else:
                assert r["forecast"] is None
    assert all(got[8, month(t)]["forecast"] is None for t in range(36, 50)) and len(got) == 4 * 24 + 14


def test_refit_does_not_see_what_follows(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=50)
    rows = lambda v: {r["date"]: r["forecast"] for r in WF.walk_forward_refit(frame(spark, {1: v}), "2002-01-01").collect()}
    one, two = rows(y), rows(np.concatenate([y[:40], y[40:] * 100 + 7]))
    assert all(one[month(t)] == pytest.approx(two[month(t)], abs=1e-7) for t in range(24, 41))
    assert WF.walk_forward_refit(frame(spark, {1: y}).limit(0), "2002-01-01").collect() == []


# --- seasonal differencing ---------------------------------------------------------------

def plain_root(y, period, most):
    """Lag count and statistic by solving every model anew."""
    d, s = np.diff(y), y[period:] - y[:-period]
    w = np.diff(s)
    at = np.arange(most, len(w))
    target, a, b = w[at], s[at], d[at]
    best = (np.inf, 0, np.nan)
    for lags in range(most + 1):
        x = np.column_stack([a, *[w[at - i] for i in range(1, lags + 1)], b])
        coef = np.linalg.lstsq(x, target, rcond=None)[0]
        sse = ((target - x @ coef) ** 2).sum()
        aic = len(at) * np.log(sse / len(at)) + 2 * (x.shape[1] + 1)
        if aic < best[0]:
            best = (aic, lags, coef[-1] / np.sqrt(sse / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[-1, -1]))
    return best[1:]


def test_seasonal_root_by_plain_models(spark):
    rng = np.random.default_rng(3)
    series, wave = {}, np.tile(10 * np.sin(2 * np.pi * np.arange(12) / 12), 15)
    for s in range(8):
        e = rng.normal(size=180)
        walk = e.copy()
        for t in range(12, 180):
            walk[t] += walk[t - 12]
        series[s] = 100 + (walk if s % 2 else 0.3 * np.roll(e, 1) + e)
    got = {r["series_id"]: r for r in SE.seasonal_root_test(frame(spark, {**series, 20: wave, 21: [4.0] * 40, 22: [1.0, 3.0]})).collect()}
    for s, y in series.items():
        lags, t = plain_root(y / np.abs(y).mean(), 12, 3)
        assert got[s]["lags"] == lags and got[s]["t_stat"] == pytest.approx(t, rel=1e-6)
        assert got[s]["seasonal_d"] == int(t >= SE.seasonal_critical(12))
    assert sum(got[s]["seasonal_d"] for s in series if s % 2) > sum(got[s]["seasonal_d"] for s in series if s % 2 == 0)
    assert [got[s]["seasonal_d"] for s in (20, 21, 22)] == [1, 0, 0] and got[22]["n"] == 0
    assert SE.seasonal_critical(12) == pytest.approx(-1.803, abs=1e-3)


def test_seasonal_difference_and_back(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=50)
    whole, period = frame(spark, {1: y, 2: y[:3]}), 4
    differences = {r["date"]: r["value"] for r in SE.seasonal_difference(whole, period).collect()}
    assert len(differences) == 46 and all(differences[month(i)] == pytest.approx(y[i] - y[i - 4]) for i in range(4, 50))
    ahead = spark.createDataFrame([(1, h, float(differences[month(29 + h)])) for h in range(1, 21)] + [(2, 1, 1.0)], "series_id int, step int, forecast double")
    back = {(r["series_id"], r["step"]): r["forecast"] for r in SE.undo_seasonal_difference(
        ahead, SE.last_season(frame(spark, {1: y[:30], 2: y[:3]}), period), period).collect()}
    assert [back[1, h] for h in range(1, 21)] == pytest.approx(y[30:]) and back[2, 1] is None


def test_seasonal_forecast_repeats_a_season(spark):
    season = np.arange(12.0) ** 2
    y = np.concatenate([season + 5 * k for k in range(8)])  # each year five higher
    out = SE.seasonal_forecast(frame(spark, {1: y, 2: [7.0, 8.0]}), 26, models=[T.LagModel(0, ())]).orderBy("series_id", "step").collect()
    assert [r["forecast"] for r in out[:26]] == pytest.approx([season[h % 12] + 5 * (8 + h // 12) for h in range(26)])
    assert {r["seasonal_d"] for r in out[:26]} == {1} and len(out) == 52 and out[0]["date"] == month(96)
    assert {r["seasonal_d"] for r in out[26:]} == {0}


def test_seasonal_interval_holds_the_truth(spark):
    rng = np.random.default_rng(5)
    series = {}
    for s in range(60):
        y = np.concatenate([rng.normal(size=12) * 5, np.zeros(120)])
        for t in range(12, 132):
            y[t] = y[t - 12] + rng.normal()
        series[s] = y
    out = SE.seasonal_forecast(frame(spark, {s: y[:108] for s, y in series.items()}), 24, critical=-99.0, models=[T.LagModel(0, ())]).collect()
    inside = np.mean([r["lower"] <= series[r["series_id"]][107 + r["step"]] <= r["upper"] for r in out])
    assert 0.9 <= inside <= 1.0


# --- changes of trend ----------------------------------------------------------------------

def test_penalised_slopes_by_slow_descent():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 30, 6))
    x[:, :, 5] = x[:, :, 4]  # two columns alike
    y = x[:, :, 0] * 3 - x[:, :, 4] + rng.normal(size=(5, 30))
    g, c = np.einsum("mni,mnj->mij", x, x), np.einsum("mni,mn->mi", x, y)
    lam = np.abs(c).max(axis=1) * 0.1
    fast = TC.descend(g, c, lam, np.zeros((5, 6)))
    slow = np.zeros((5, 6))
    for _ in range(5000):
        for k in range(6):
            slow[:, k] = TC._soft(c[:, k] - np.einsum("mj,mj->m", g[:, k], slow) + g[:, k, k] * slow[:, k], lam) / g[:, k, k]
    cost = lambda b: 0.5 * np.einsum("mi,mij,mj->m", b, g, b) - np.einsum("mi,mi->m", b, c) + lam * np.abs(b).sum(axis=1)
    assert np.allclose(cost(fast), cost(slow), rtol=1e-8) and (TC.violations(g, c, fast, lam) <= 1e-6 * np.abs(c).max(axis=1)).all()
    assert np.allclose(fast[:, :4], slow[:, :4], atol=1e-6)


def test_a_known_change_is_found(spark):
    rng = np.random.default_rng(7)
    t = np.arange(120)
    bend = np.where(t < 60, t * 1.0, 60 - (t - 60) * 2.0) + rng.normal(size=120) * 0.3
    straight = 3.0 * t + rng.normal(size=120) * 0.3
    settings = TC.TrendChanges(changes=16, pairs=1)
    df = frame(spark, {1: bend, 2: straight, 3: [5.0] * 30, 4: [2.0], 5: [1.0, None, 4.0]})
    fit = TC.fit_trend_changes(df, settings=settings)
    changes = [r for r in TC.trend_changes(fit, settings).collect() if r["series_id"] == 1]
    main = max(changes, key=lambda r: abs(r["change_per_year"]))
    assert abs((main["date"] - month(60)).days) < 250 and sum(r["change_per_year"] for r in changes) == pytest.approx(-36, rel=0.1)
    out = {(r["series_id"], r["step"]): r for r in TC.trend_change_forecast(df, 12, settings=settings).collect()}
    assert out[1, 12]["forecast"] == pytest.approx(60 - 71 * 2.0, abs=4) and out[2, 12]["forecast"] == pytest.approx(3 * 131, abs=2)
    assert out[1, 12]["upper"] - out[1, 12]["lower"] > out[1, 1]["upper"] - out[1, 1]["lower"] > 0
    assert out[3, 5]["forecast"] == pytest.approx(5) and out[4, 1]["forecast"] == pytest.approx(2) and out[4, 1]["lower"] is None
    checks = {r["series_id"]: r for r in TC.optimality(df, fit, settings=settings).collect()}
    assert checks[1]["excess"] < 1e-6 and checks[1]["cosine"] < 1e-9 and checks[5]["n"] == 2 and checks[5]["excess"] is None


def test_trend_changes_with_a_regressor(spark):
    rng = np.random.default_rng(8)
    x, t = rng.normal(size=90), np.arange(90)
    y = 2.0 * t + 7.0 * x
    rows = [(1, month(i), float(y[i]), None if i == 3 else float(x[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "series_id int, date date, value double, x double")
    ahead = spark.createDataFrame([(1, month(90), 10.0)], "series_id int, date date, x double")
    out = TC.trend_change_forecast(df, 2, ["x"], ahead, TC.TrendChanges(pairs=0)).orderBy("step").collect()
    assert out[0]["forecast"] == pytest.approx(180 + 70, abs=3) and out[1]["forecast"] == pytest.approx(182 + 7 * x[-1], abs=3)
    assert TC.fit_trend_changes(df.limit(0), ["x"]).collect() == []
