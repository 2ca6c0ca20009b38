"""Chains, folds, stacking and selection on a small panel with a known signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrospark.constants import BASE_WEIGHTS, TARGETS
from macrospark.learning import features as L, models as M
from macrospark.operators import joins as J, stats as A

IDS = ["series_id", "date"]
INPUTS = ["x0", "x1", "x2"]
SMALL = M.Trees(trees=4, depth=3, rate=0.5, sample=1.0)
FOREST = M.Trees(kind="forest", trees=5, depth=4)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    base = 100 / (1 + np.exp(-2 * x[:, 0]))
    pdf = pd.DataFrame(x, columns=INPUTS).assign(
        series_id=np.repeat(np.arange(4), n // 4), date=np.tile(pd.date_range("2000-01-01", periods=n // 4, freq="MS").date, 4))
    for i, t in enumerate(TARGETS):
        pdf[t] = np.clip(base + rng.normal(0, 1 + i, n), 0, 100)
    return spark.createDataFrame(pdf).cache()


def test_folds_partition_rows_evenly(panel):
    folded = L.assign_folds(A.quartile_bins(panel, TARGETS[0]), 5, IDS, "bin")
    assert folded.count() == panel.count()
    per = folded.groupBy("bin", "fold").count().toPandas().pivot(index="bin", columns="fold", values="count").fillna(0)
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()


def test_scaling_moments(panel):
    scaled = L.apply_scale(panel, L.fit_standard(panel, INPUTS)).agg(F.avg("x1"), F.stddev_pop("x1")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    fast = L.fit_robust(panel, INPUTS)
    pdf = panel.select(INPUTS).toPandas()
    for c in INPUTS:
        assert fast[c] == pytest.approx((pdf[c].median(), pdf[c].quantile(0.75) - pdf[c].quantile(0.25)))


def test_constant_column_is_not_divided_by_zero(panel):
    flat = panel.withColumn("k", F.lit(7.0))
    assert L.fit_standard(flat, ["k"])["k"] == (7.0, 1.0) and L.fit_robust(flat, ["k"])["k"] == (7.0, 1.0)


def test_meta_features(spark):
    cols = L.meta_features([F.lit(1.0), F.lit(2.0), F.lit(6.0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert len(cols) == 11 and row["mean"] == 3.0
    assert row["weighted"] == pytest.approx(np.dot(BASE_WEIGHTS, [1, 2, 6])) and row["std"] == pytest.approx(np.std([1, 2, 6]))
    assert (row["min"], row["max"], row["diff_0_1"], row["diff_0_2"], row["diff_1_2"]) == (1, 6, 1, 5, 4)


def test_chain_learns_stays_in_range_and_survives_storage(spark, panel, tmp_path):
    chain = M.RegressorChain(INPUTS, settings=SMALL).fit(panel)
    out = chain.transform(panel).cache()
    assert out.count() == panel.count()
    for t in TARGETS:
        lo, hi = out.agg(F.min(f"pred_{t}"), F.max(f"pred_{t}")).first()
        assert 0 <= lo and hi <= 100
    metrics = {r["target"]: r["r2"] for r in M.evaluate(out, TARGETS).collect()}
    assert min(metrics.values()) > 0.5
    # The inputs come back unscaled.
    assert out.join(panel.select(*IDS, F.col("x0").alias("y0")), IDS).filter(F.abs(F.col("x0") - F.col("y0")) > 1e-9).count() == 0
    chain.save(str(tmp_path / "m"), spark, note="test")
    again = M.RegressorChain.load(str(tmp_path / "m"), spark).transform(panel)
    cols = [*IDS, *[f"pred_{t}" for t in TARGETS]]
    assert again.select(cols).orderBy(*IDS).collect() == out.select(cols).orderBy(*IDS).collect()


def test_stacking_and_out_of_fold(panel):
    bases = {"boosted": SMALL, "boosted_deep": SMALL, "forest": FOREST}
    model = M.StackingEnsemble(INPUTS, IDS, bases, TARGETS[:1], folds=2, alphas=[0.05, 2.0]).fit(panel)
    out = model.transform(panel)
    assert out.columns == [*panel.columns, f"pred_{TARGETS[0]}"]
    assert M.evaluate(out, TARGETS[:1]).first()["r2"] > 0.5
    assert model.metas[TARGETS[0]].alpha == 0.05


def test_out_of_fold_covers_every_row_once(panel):
    folded = L.assign_folds(panel, 2, IDS)
    out = M.out_of_fold(folded, "fold", 2, lambda df: M.RegressorChain(INPUTS, TARGETS[:1], FOREST, "standard").fit(df), "p_")
    assert out.select(*IDS).distinct().count() == panel.count() == out.count()


def test_selection_finds_the_signal(panel):
    top = M.select_features(panel, INPUTS, TARGETS[:2], FOREST, 1, ["x2"])
    assert {r["feature"] for r in top.filter("rank = 1").collect()} == {"x0"}
    assert {r["feature"] for r in top.filter("selected").collect()} == {"x0", "x2"}
    left = M.eliminate_features(panel, INPUTS, TARGETS[0], IDS, FOREST, keep=1, folds=2)
    assert left.filter("feature = 'x0'").first()["selected"]


def test_weights_and_ridge(panel, spark):
    row = spark.range(1).select(M.high_value_weight(F.lit(0.0)).alias("a"), M.high_value_weight(F.lit(100.0)).alias("b")).first()
    assert row["a"] == 1.0 and row["b"] > 10
    ridge = M.fit_ridge(panel, ["x0"], TARGETS[0], alpha=10.0)
    x, y = (np.array(c) for c in zip(*panel.select("x0", TARGETS[0]).collect()))
    z = (x - x.mean()) / x.std()
    want = (z @ (y - y.mean())) / (z @ z + 10.0)
    assert ridge.model.stages[-1].coefficients[0] == pytest.approx(want, rel=1e-4)


def test_elastic_net_penalty(panel):
    meta = M.fit_meta(panel, ["x0"], TARGETS[0], IDS, [2.0])
    x, y = (np.array(c) for c in zip(*panel.select("x0", TARGETS[0]).collect()))
    z = (x - x.mean()) / x.std()
    # One standardized input: soft threshold by alpha / 2, shrink by 1 + alpha / 2.
    want = (z @ (y - y.mean()) / len(z) - 1.0) / (1.0 + 1.0)
    assert meta.model.stages[-1].coefficients[0] == pytest.approx(want, rel=1e-3)


def test_settings_search_orders_by_error(panel):
    grid = [M.Trees(trees=1, depth=1, rate=0.1), M.Trees(trees=4, depth=4, rate=0.5, sample=1.0)]
    out = M.search_settings(panel, INPUTS, TARGETS[0], "date", grid).collect()
    assert [r["config"] for r in out] == [1, 0] and out[0]["rmse"] < out[1]["rmse"]


def test_hybrid_and_comparison(panel):
    metrics, fitted = M.train_and_compare(panel, "2006-01-01", {
        "full": M.RegressorChain(INPUTS, TARGETS[:2], FOREST, "standard"), "hybrid": M.HybridChain(INPUTS, TARGETS[:2], FOREST)}, TARGETS[:2])
    table = A.compare_models(metrics, "full", "hybrid").collect()
    assert {r["target"] for r in table} == set(TARGETS[:2]) and set(fitted) == {"full", "hybrid"}


def test_what_if_row(panel):
    chain = M.RegressorChain(INPUTS, TARGETS[:1], SMALL).fit(panel)
    last = J.last_row(panel)
    low, high = (chain.transform(last.withColumn("x0", F.lit(v))).agg(F.avg(f"pred_{TARGETS[0]}")).first()[0] for v in (-2.0, 2.0))
    assert high - low > 30


def test_parallel_jobs_do_not_share_properties(spark):
    jobs = [lambda i=i: [spark.range(i).count() for _ in range(15)] for i in range(8)]
    assert M.together(spark, jobs, 8) == [[i] * 15 for i in range(8)]


def test_successive_halving(panel):
    """Fewer settings and more trees each round; the winner comes near the best of all settings fitted in full."""
    settings = M.drawn_settings(9, 9)
    assert len(set(settings)) == 9 and {s.depth for s in settings} <= set(range(2, 8))
    rows = M.search_halving(panel, INPUTS, TARGETS[0], "date", settings).toPandas()
    assert rows.groupby("round").size().to_dict() == {0: 9, 1: 3, 2: 1}
    assert rows.groupby("round")["trees"].unique().map(list).to_dict() == {0: [1], 1: [3], 2: [9]}
    for turn in (0, 1):
        kept = rows[(rows["round"] == turn) & rows["kept"]]
        assert kept["rmse"].max() <= rows[(rows["round"] == turn) & ~rows["kept"]]["rmse"].min()
        assert set(kept["config"]) == set(rows[rows["round"] == turn + 1]["config"])
    grid = M.search_settings(panel, INPUTS, TARGETS[0], "date", settings).toPandas()
    assert rows.iloc[0]["rmse"] <= 1.1 * grid["rmse"].min()


def test_halving_refuses_nothing_to_search(panel):
    with pytest.raises(ValueError):
        M.search_halving(panel, INPUTS, TARGETS[0], "date", [])
