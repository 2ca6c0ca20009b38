"""Point-in-time values, augmented tests, vector models and moving averages against plain computations."""

import datetime as dt
import random

import numpy as np
import pytest

from macrospark.functions import scalar as SC
from macrospark.operators import asof as AO, blocks as B, moving_average as MA, stationarity as S, vector as V

DAY = dt.date(2000, 1, 1)


def day(k):
    return None if k is None else DAY + dt.timedelta(days=k)


@pytest.mark.parametrize("ranges", [2, 40])
def test_as_of_by_brute_force(spark, ranges):
    rng = random.Random(ranges)
    versions = [(rng.choice([1, 1, 1, 1, 2, 3]), day(rng.randrange(300)), i, rng.choice([None, float(i)]), day(rng.choice([None, 400, 150]))) for i in range(400)]
    versions += [(None, day(3), 900, 1.0, None), (4, None, 901, 1.0, None)]
    asks = [(rng.choice([1, 2, 3, 4, None]), day(rng.choice([None, *range(-5, 310)])), rng.randrange(50)) for _ in range(500)]
    asks += [asks[0]] * 3
    got = AO.as_of(spark.createDataFrame(versions, "series_id int, realtime_start date, rev int, value double, until date"),
                   spark.createDataFrame(asks, "series_id int, as_of date, ask int"), end="until", ties=["rev"], ranges=ranges).collect()
    want = []
    for s, at, ask in asks:
        known = [v for v in versions if s is not None and at is not None and v[0] == s and v[1] is not None and v[1] <= at]
        last = max(known, key=lambda v: (v[1], v[2])) if known else None
        ok = last is not None and (last[4] is None or at <= last[4])
        want.append((s, at, ask, last[1] if ok else None, last[3] if ok else None))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_as_of_of_nothing(spark):
    versions = spark.createDataFrame([], "series_id int, realtime_start date, value double")
    asks = spark.createDataFrame([(1, DAY)], "series_id int, as_of date")
    assert [tuple(r) for r in AO.as_of(versions, asks).collect()] == [(1, DAY, None, None)]
    assert AO.as_of(versions, asks.limit(0)).collect() == []


def plain_adf(y, most):
    """Lag count and statistic by solving every model anew."""
    best = (np.inf, 0, np.nan)
    change, n = np.diff(y), len(y) - 1 - most
    for lags in range(most + 1):
        x = np.column_stack([np.ones(n), *[change[most - i:len(change) - i] for i in range(1, lags + 1)], y[most:-1]])
        coef, _, _, _ = np.linalg.lstsq(x, change[most:], rcond=None)
        sse = ((change[most:] - x @ coef) ** 2).sum()
        aic = n * np.log(sse / n) + 2 * (x.shape[1] + 1)
        if n > x.shape[1] and aic < best[0]:
            best = (aic, lags, coef[-1] / np.sqrt(sse / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[-1, -1]))
    return best[1:]


def test_augmented_order_by_plain_models(spark):
    rng = np.random.default_rng(2)
    rows, series = [], {}
    for s in range(12):
        e = rng.normal(size=80)
        y = np.cumsum(np.cumsum(e)) if s % 3 == 0 else np.cumsum(e + 0.6 * np.roll(e, 1)) if s % 3 == 1 else e + 0.5 * np.roll(e, 2)
        series[s] = y + 1000
        rows += [(s, dt.date(2000 + i // 12, 1 + i % 12, 1), float(v)) for i, v in enumerate(series[s])]
    rows += [(50, dt.date(2000, 1 + i, 1), 5.0) for i in range(12)] + [(51, DAY, 1.0)]
    got = {r["series_id"]: r for r in S.augmented_order(spark.createDataFrame(rows, "series_id int, date date, value double")).collect()}
    for s, y in series.items():
        stats = [plain_adf(np.diff(y, n=k), 4) for k in range(3)]
        for k, (lags, t) in enumerate(stats):
            assert got[s][f"lags{k}"] == lags and got[s][f"t{k}"] == pytest.approx(t, rel=1e-6)
        assert got[s]["d"] == next((k for k in range(2) if stats[k][1] < -2.86), 2)
    assert got[50]["d"] == 0 and got[50]["t0"] is None and got[51]["n0"] == 0


def test_vector_orders_by_plain_models():
    rng = np.random.default_rng(4)
    work, regressors = rng.normal(size=(70, 2)), rng.normal(size=(70, 3))
    for t in range(2, 70):
        work[t] += 0.6 * work[t - 2] + regressors[t, :2]
    regressors = np.column_stack([regressors, regressors[:, 0] * 2])  # a regressor that another one explains
    fit = V.fit_orders(work, regressors, (1, 2, 3, 4))
    best = (np.inf, None, None)
    x = V.design(work, regressors, 4)
    for p in (1, 2, 3, 4):
        cols = [*range(4), *range(5, 5 + 2 * p)]
        coef = np.linalg.lstsq(x[:, cols], work[4:], rcond=None)[0]
        left = work[4:] - x[:, cols] @ coef
        aic = len(x) * np.linalg.slogdet(left.T @ left / len(x))[1] + 4 * (len(cols) + 1.5)
        if aic < best[0]:
            best = (aic, p, coef)
    assert fit.p == best[1] >= 2 and fit.cosine < 1e-9 and np.allclose(fit.coef, best[2])


def test_vector_forecast_of_known_paths(spark):
    """A square series differenced twice, a line differenced once, a wave of order two, and a key too short."""
    month = lambda i: dt.date(2000 + i // 12, 1 + i % 12, 1)
    rng = np.random.default_rng(5)
    rows = [(1, month(i), float(i * i), 3.0 * i, float(np.cos(0.5 * i)), float(rng.normal())) for i in range(60)] + [(2, month(0), 4.0, None, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id int, date date, square double, line double, wave double, noise double")
    out = V.vector_model_forecast(df, ["square", "line", "wave"], 4, ["noise"], orders=(2,), d={"square": 2, "line": 1}).orderBy("series_id", "step").collect()
    for h, r in enumerate(out[:4]):
        i = 60 + h
        assert (r["square"], r["line"], r["wave"]) == pytest.approx((i * i, 3.0 * i, np.cos(0.5 * i)), rel=1e-5, abs=1e-6) and r["date"] == month(i)
    assert [(r["p"], r["square"], r["line"], r["wave"]) for r in out[4:]] == [(None, 4.0, 0.0, 6.0)] * 4
    with pytest.raises(ValueError):
        V.vector_model_forecast(df, ["line"], 1, d=3)


def test_ranked_regressors():
    rng = np.random.default_rng(6)
    t = rng.normal(size=(50, 2))
    c = np.column_stack([np.full(50, 7.0), t[:, 0], rng.normal(size=50), t[:, 0]])
    assert V.ranked_regressors(t, c, 3) == [1, 3, 2] and V.ranked_regressors(t, c, 9)[-1] == 0


def plain_moving_average(y, grid, long, p_most, q_most):
    """Both rounds with dense matrices: order, coefficients and first forecast."""
    lagged = lambda v, k, n: np.column_stack([v[n - i:len(v) - i] for i in range(1, k + 1)]) if k else np.empty((len(v) - n, 0))
    x = np.column_stack([np.ones(len(y) - long), lagged(y, long, long)])
    e = np.concatenate([np.full(long, np.nan), y[long:] - x @ np.linalg.lstsq(x, y[long:], rcond=None)[0]])
    start = long + q_most
    best = (np.inf, None, None, None)
    for p, k in grid:
        x = np.column_stack([np.ones(len(y) - start), lagged(y, p, start), lagged(e, k, start)])
        coef = np.linalg.lstsq(x, y[start:], rcond=None)[0]
        sse = ((y[start:] - x @ coef) ** 2).sum()
        aic = len(x) * np.log(sse / len(x)) + 2 * (len(coef) + 1)
        if aic < best[0]:
            best = (aic, (p, k), coef, coef @ np.concatenate([[1.0], y[::-1][:p], e[::-1][:k]]))
    return best


def test_moving_average_by_dense_matrices(spark):
    rng = np.random.default_rng(8)
    rows, series = [], {}
    for s in range(6):
        e = rng.normal(size=203)
        y = 50 + e + 0.8 * np.roll(e, 1) if s % 2 else 50 + e
        series[s] = y[3:]
        rows += [(s, dt.date(2000 + i // 12, 1 + i % 12, 1), float(v)) for i, v in enumerate(series[s])]
    rows += [(50, DAY, 3.0), (50, dt.date(2000, 2, 1), 4.0), (51, DAY, None)]
    frame = spark.createDataFrame(rows, "series_id int, date date, value double")
    got = {(r["series_id"], r["step"]): r for r in MA.moving_average_forecast(frame, 3).collect()}
    for s, y in series.items():
        unit = np.abs(y).mean()
        _, (p, k), coef, ahead = plain_moving_average(y / unit, MA.ARMA_GRID, 6, 3, 2)
        one = got[s, 1]
        assert (one["p"], one["q"]) == (p, k) and one["forecast"] == pytest.approx(ahead * unit, rel=1e-8)
        assert one["upper"] - one["lower"] < got[s, 3]["upper"] - got[s, 3]["lower"] + 1e-9
        if s % 2:
            assert p + k > 0  # the moving average is seen
    assert got[50, 2]["forecast"] == 4.0 and got[50, 2]["p"] is None and (51, 1) in got


def test_moving_average_of_differences(spark):
    line = [(1, dt.date(2000 + i // 12, 1 + i % 12, 1), 2.0 * i + (-1) ** i) for i in range(60)]
    out = MA.moving_average_forecast(spark.createDataFrame(line, "series_id int, date date, value double"), 2, [(1, 0)], d=1).orderBy("step").collect()
    assert [r["forecast"] for r in out] == pytest.approx([2.0 * 60 + 1, 2.0 * 61 - 1], rel=1e-6)


def test_numbering_in_ranges(spark):
    """Labels with one beginning are numbered in even ranges, and as a plain sort would."""
    labels = [f"Brand#{k:05d}" for k in range(4000)]
    frame = spark.createDataFrame([(x,) for x in labels] + [(None,), (labels[7],)], "label string").repartition(6)
    got = {r["label"]: r["code"] for r in SC.label_codes(frame, "label").collect()}
    assert got == {x: i for i, x in enumerate(sorted([*labels, "Unknown"]))}
    cut = frame.distinct().repartitionByRange(8, "label").rdd.glom().map(len).collect()
    assert max(cut) <= 2 * sum(cut) / len(cut)
    assert B.number_in_order(frame.limit(0), "label").collect() == []
