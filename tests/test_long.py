"""Operators on series and tables of any length or width."""

import numpy as np
import pandas as pd
import pytest

from macrospark.operators import blocks as B, decompose as D, long_loess as L, wide as X
from tests.test_properties import wave


def long_series(spark, lengths, holes=()):
    rng = np.random.default_rng(5)
    parts = []
    for k, n in lengths.items():
        y = 50 + 0.01 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / 4) + rng.normal(0, 1, n) + np.cumsum(rng.normal(0, 0.2, n))
        y[rng.random(n) < 0.01] += 40
        parts.append(pd.DataFrame({"series_id": k, "n": np.arange(n), "value": y}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf["n"].isin(holes), "value"] = np.nan
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).replace(float("nan"), None, ["value"])
    return df, pdf


@pytest.mark.parametrize("robust", [False, True])
def test_blocks_equal_whole_series(spark, robust):
    """Blocks of 200 rows with halos give what the whole series gives; so do series shorter than a block."""
    df, pdf = long_series(spark, {"a": 1500, "b": 1003, "c": 90, "short": 7}, holes=[0, 1, 200, 201, 777])
    got = L.decompose_loess_long(df, 4, 7, robust, order="n", size=200, outer=2).toPandas().sort_values(["series_id", "n"])
    assert len(got) == len(pdf)
    for k, rows in got.groupby("series_id"):
        y = pdf[pdf["series_id"] == k]["value"].ffill().bfill().to_numpy()
        assert np.allclose(rows["value"], y)
        if k == "short":
            assert rows[["trend", "seasonal", "residual"]].isna().all().all()
            continue
        season, trend = D.stl_arrays(y, 4, 7, robust, outer=2, flat=L.FLAT)
        assert np.abs(rows["trend"] - trend).max() < 1e-8 and np.abs(rows["seasonal"] - season).max() < 1e-8
        assert np.allclose(rows["trend"] + rows["seasonal"] + rows["residual"], y)


def test_dense_and_windowed_smoothing_agree(monkeypatch):
    y = wave(400, noise=2.0)
    dense = D.stl_arrays(y, robust=True, outer=2)
    monkeypatch.setattr(D, "DENSE", 10)
    assert np.allclose(dense, D.stl_arrays(y, robust=True, outer=2))


def test_series_without_values(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(40)], "series_id string, n long, value double")
    out = L.decompose_loess_long(df, 4, 7, order="n", size=20)
    assert out.count() == 40 and out.filter("trend is not null or value is not null").count() == 0
    assert L.decompose_loess_long(df.limit(0), 4, 7, order="n").count() == 0


# --- many columns ---------------------------------------------------------------------

def test_wide_correlations_equal_pairwise(spark):
    """Tiles, strips and null patterns give each pair's own correlation, at any offset of the columns."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    x = base @ rng.normal(size=(3, 37)) + rng.normal(size=(300, 37)) + 10.0 ** rng.integers(0, 6, 37)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5], x[:, 6], x[1:, 7] = np.nan, 0.1, np.nan
    cols = [f"c{i:02d}" for i in range(37)]
    pdf = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    got = {(r["left"], r["right"]): (r["n"], r["correlation"]) for r in X.wide_correlations(df, cols, tile=8, budget=8 * 6 * 64 * 4).collect()}
    assert len(X.strips(37, 8, 8 * 6 * 64 * 4)) == 4
    want, known = pdf.corr().abs(), pdf.notna().astype(int)
    common = known.T @ known
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if common.loc[a, b] == 0:
                assert (a, b) not in got
                continue
            n, c = got.pop((a, b))
            assert n == common.loc[a, b]
            if np.isnan(want.loc[a, b]) or "c06" in (a, b):
                assert c is None
            else:
                assert c == pytest.approx(want.loc[a, b], abs=1e-9)
    assert not got
    assert X.wide_correlations(df.limit(0), cols).count() == 0 and X.wide_correlations(df, cols[:1]).count() == 0


def test_very_many_columns(spark):
    """Twelve hundred columns, 719,400 pairs, none of them an expression of its own."""
    from pyspark.sql import functions as F
    width = 1200
    df = spark.range(0, 200, 1, 2).select(*[F.sin(F.col("id") * F.lit(1.0 + i % 50)).alias(f"c{i}") for i in range(width)])
    out = X.wide_correlations(df, [f"c{i}" for i in range(width)])
    place = lambda c: F.substring(c, 2, 9).cast("int") % 50
    row = out.agg(F.count(F.lit(1)).alias("pairs"), F.max("correlation").alias("top"),
                  F.min(F.when(place("left") == place("right"), F.col("correlation"))).alias("same")).first()
    assert row["pairs"] == width * (width - 1) // 2 and row["top"] <= 1.0 and row["same"] == pytest.approx(1.0, abs=1e-9)


def test_ranks_in_ranges(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b"], 3000, p=[0.95, 0.05]), "id": np.arange(3000), "x": rng.integers(0, 700, 3000).astype(float)})
    pdf.loc[:20, "x"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = B.rank_in_order(df, "x", "k", ranges=7).toPandas().sort_values("id")["rank"].to_numpy()
    assert (got == pdf.groupby("k")["x"].rank(method="min", na_option="top").to_numpy()).all()
    assert B.rank_in_order(df.limit(0), "x", "k").count() == 0
