"""What a task holds does not grow with the input."""

import numpy as np
import pandas as pd
import pytest

from pyspark.ml.regression import GBTRegressor

from macrospark import columns
from macrospark.learning.models import Trees
from macrospark.operators import decompose as D, forecast as T, trend_changes as TC, udf as U, windows as W
from macrospark.plans import pipelines as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [24, 30, 600])
def test_robust_loess_of_many_series_is_that_of_each(n):
    y = np.random.default_rng(n).gamma(2, 100, (4, n))
    y[1, n // 2] *= 50
    season, trend = D.stl_arrays(y, robust=True)
    for i, row in enumerate(y):
        alone = D.stl_arrays(row, robust=True)
        assert (season[i] == alone[0]).all() and (trend[i] == alone[1]).all()


def test_trend_changes_are_fitted_few_at_a_time(spark, monkeypatch):
    fit_batch, most = TC.fit_batch, TC.TOGETHER

    def checked(designs, hinges, values, settings):
        assert len(values) <= most
        return fit_batch(designs, hinges, values, settings)

    monkeypatch.setattr(TC, "fit_batch", checked)
    rows = spark.range(4000 * 5).selectExpr("id div 5 AS series_id", "add_months(DATE'2000-01-01', CAST(id % 5 AS INT)) AS date", "CAST(id * id % 17 AS DOUBLE) AS value")
    assert TC.fit_trend_changes(rows, settings=TC.TrendChanges(pairs=0)).count() == 4000


def test_tasks_follow_the_files(spark, monkeypatch, tmp_path):
    pd.DataFrame({"series_id": np.repeat(np.arange(50), 30), "date": np.tile(pd.date_range("2000-01-01", periods=30, freq="MS").date, 50),
                  "value": np.random.default_rng(3).gamma(2, 9, 1500)}).to_parquet(tmp_path / "rows.parquet")
    rows = spark.read.parquet(str(tmp_path / "rows.parquet"))
    assert columns.spread(rows, "series_id").rdd.getNumPartitions() == 4
    before = {f: sorted(map(str, f(rows).collect())) for f in (D.decompose, D.decompose_multiplicative, W.upsample_monthly)}
    monkeypatch.setattr(columns, "TASK_BYTES", 1 << 9)
    many = columns.spread(rows, "series_id").rdd.getNumPartitions()
    assert many > 8
    for f, found in before.items():
        made = f(rows)
        assert f", {many})" in _plan(made)
        assert sorted(map(str, made.collect())) == found
    ahead = rows.selectExpr("series_id", "add_months(date, 30) AS date", "value").where("date < '2002-10-01'")
    assert f", {many})" in _plan(D.decompose_forecast(rows, ahead))
    finer = columns.spread(rows, "series_id", 4).rdd.getNumPartitions()
    assert finer > 3 * many and f", {finer})" in _plan(T.box_cox_lambda(rows, refine=False))


def test_series_travel_together(spark):
    rows = spark.range(2000).selectExpr("CASE WHEN id % 400 > 0 THEN id % 400 END AS k", "CASE WHEN id % 400 > 7 OR id > 1000 THEN id END AS n", "CASE WHEN id % 9 > 0 THEN id % 2 = 0 END AS b", "CAST(id AS DOUBLE) AS v")
    rows = rows.unionByName(spark.range(25_000).selectExpr("-1L AS k", "id AS n", "true AS b", "1.0D AS v"))  # one series of several batches

    def look(pdf):
        assert pdf.index.equals(pd.RangeIndex(len(pdf)))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "rows": len(pdf), "n": str(pdf["n"].dtype), "b": str(pdf["b"].dtype), "v": pdf["v"].sum()})

    schema = "k long, rows long, n string, b string, v double"
    made = U.apply_per_series(rows, "k", look, schema)
    assert "MapInPandas" in _plan(made) and "FlatMapGroups" not in _plan(made)
    assert sorted(map(str, made.collect())) == sorted(map(str, rows.groupBy("k").applyInPandas(look, schema).collect()))


def test_products_of_a_key_are_one_array(spark):
    rows = spark.range(900).selectExpr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN double('nan') ELSE double(id % 7) END AS k", "CASE WHEN id % 11 > 0 THEN double(id % 13) END AS a",
                                       "CASE WHEN id % 17 > 0 THEN double(id % 5) ELSE double('inf') END AS b", "double(id) AS y", "CASE WHEN id % 7 < 6 THEN double(id % 3) END AS z")
    wide = T.wide_gram(rows, ["a", "b"], ["y", "z"], "k")
    assert "Generate" not in _plan(wide)
    want = {str(r["k"]): r for r in T.gram(rows, ["a", "b"], ["y", "z"], "k").collect()}
    got = {str(r["k"]): r for r in wide.collect()}
    assert len(want) == 6 and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["n"] == r["n"]
        for c in ("xx", "xy", "yy"):
            assert np.allclose(np.array(got[k][c]), np.array(r[c]), rtol=1e-12)


def test_residual_model_is_fitted_on_kept_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"series_id": np.repeat(["a", "b", "c"], 40), "date": np.tile(pd.date_range("2000-01-01", periods=40, freq="MS").date, 3),
                         "actual": rng.normal(100, 5, 120), "base": rng.normal(100, 5, 120)})
    fit, seen = GBTRegressor.fit, []

    def checked(self, df, *rest):
        seen.append(_plan(df))
        return fit(self, df, *rest)

    monkeypatch.setattr(GBTRegressor, "fit", checked)
    model, unit = P.fit_residual_model(spark.createDataFrame(rows), Trees(trees=2, depth=2))
    assert len(seen) == 1 and "Window" not in seen[0] and "Join" not in seen[0]
    assert unit.count() == 3 and len(model.stages) == 2
