"""Queries for scaling, folds, trees, chains, stacking and model storage. The
settings are small versions of the defaults; the frame is every supplier's panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from macrospark.columns import q
from macrospark.constants import INDICATORS, TARGETS
from macrospark.functions.scalar import percent_to_share
from macrospark.learning import features as L, models as M
from macrospark.operators import clean as C, joins as J, stats as A, windows as W
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import ECONOMY, PART_OBS, SPLIT, economy, economy_targets, part_obs
from macrospark.session import cut_lineage, scratch_path

Spark = SparkSession
IDS = ["series_id", "date"]
FEATURES = [*INDICATORS, "recession_probability_lag1", "CPI_lag1", "INDPRO_lag1"]
SMALL = M.Trees(trees=3, depth=3, rate=0.3, sample=1.0)
FOREST = M.Trees(kind="forest", trees=5, depth=4, min_leaf=5)


def _frame(spark: Spark, sf: str) -> DataFrame:
    """Complete rows of features and targets."""
    wide = economy_targets(spark, sf)
    for c in ("recession_probability", "CPI", "INDPRO"):
        wide = W.lags(wide, [1], value=c)
    return C.complete_rows(wide)


def _sides(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    return C.split_at(cut_lineage(_frame(spark, sf)), SPLIT)


def _predicted(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    return df.select(*IDS, *[q(f"pred_{t}") for t in targets])


# --- scaling, folds, meta-features -----------------------------------------------------

_COLS = INDICATORS


@query("mlo1_standard_scale", f"""WITH {ECONOMY} SELECT series_id, {d()}, {', '.join(
    r(f'("{c}" - avg("{c}") OVER ()) / (stddev_pop("{c}") OVER ())', f'"{c}"') for c in _COLS)} FROM econ""")
def _standard(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf).select(*IDS, *[q(c) for c in _COLS])
    return L.apply_scale(e, L.fit_standard(e, _COLS))


@query("mlo1_robust_scale", f"""WITH {ECONOMY}, s AS (SELECT {', '.join(
    f'quantile_cont("{c}", 0.5) AS m{i}, quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS w{i}' for i, c in enumerate(_COLS))} FROM econ)
 SELECT series_id, {d()}, {', '.join(r(f'("{c}" - m{i}) / CASE WHEN w{i} < 1e-6 THEN 1 ELSE w{i} END', f'"{c}"') for i, c in enumerate(_COLS))} FROM econ, s""")
def _robust(spark: Spark, sf: str) -> DataFrame:
    e = economy(spark, sf).select(*IDS, *[q(c) for c in _COLS])
    return L.apply_scale(e, L.fit_robust(e, _COLS))


_HASH = "md5('42|' || series_id || '|' || strftime(date, '%Y-%m-%d'))"


@query("mlo6_stratified_folds", f"""WITH {PART_OBS}, e AS (SELECT quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS dd, max(value) AS z FROM obs),
 x AS (SELECT series_id, date, (value >= b)::INTEGER + (value >= c)::INTEGER + (value >= dd)::INTEGER + (value >= z)::INTEGER AS bin FROM obs, e)
 SELECT series_id, {d()}, bin::BIGINT AS bin, (row_number() OVER (PARTITION BY bin ORDER BY {_HASH}, series_id, date) - 1) % 8 AS fold FROM x""")
def _stratified(spark: Spark, sf: str) -> DataFrame:
    binned = A.quartile_bins(part_obs(spark, sf), "value").drop("value")
    return L.assign_folds(binned, 8, IDS, "bin")


@query("mlo6_plain_folds", f"""WITH {PART_OBS} SELECT series_id, {d()}, (row_number() OVER (ORDER BY {_HASH}, series_id, date) - 1) % 3 AS fold FROM obs""")
def _plain(spark: Spark, sf: str) -> DataFrame:
    return L.assign_folds(part_obs(spark, sf).drop("value"), 3, IDS)


@query("mlo8_meta_features", f"""WITH {ECONOMY}, b AS (SELECT series_id, date, "1_year_rate" AS x, "3_months_rate" AS y, "10_year_rate" AS z FROM econ), m AS (SELECT *, (x + y + z) / 3 AS mean FROM b)
 SELECT series_id, {d()}, {r('x', 'base_0')}, {r('y', 'base_1')}, {r('z', 'base_2')}, {r('mean')}, {r('0.4::DOUBLE * x + 0.35::DOUBLE * y + 0.25::DOUBLE * z', 'weighted')},
 {r('sqrt(((x - mean) * (x - mean) + (y - mean) * (y - mean) + (z - mean) * (z - mean)) / 3)', 'std')}, {r('least(x, y, z)', 'min')}, {r('greatest(x, y, z)', 'max')},
 {r('abs(x - y)', 'diff_0_1')}, {r('abs(x - z)', 'diff_0_2')}, {r('abs(y - z)', 'diff_1_2')} FROM m""")
def _meta(spark: Spark, sf: str) -> DataFrame:
    cols = L.meta_features([q("1_year_rate"), q("3_months_rate"), q("10_year_rate")])
    return economy(spark, sf).select(*IDS, *[c.alias(n) for n, c in cols.items()])


@query("mlo14_sample_weights", f"""WITH {ECONOMY} SELECT series_id, {d()}, {r('exp(3.0::DOUBLE * least(greatest(recession_probability, 0), 100) / 100)', 'sample_weight')} FROM econ""")
def _weights(spark: Spark, sf: str) -> DataFrame:
    return economy(spark, sf).select(*IDS, M.high_value_weight(q("recession_probability")).alias("sample_weight"))


# --- models -------------------------------------------------------------------------------

TARGET = TARGETS[1]


@query("mlo2_boosted_trees")
def _boosted(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    model = M.fit_boosted(train, FEATURES, TARGET, "date", SMALL)
    return M.score(model, test, "prediction").select(*IDS, "prediction")


@query("mlo3_random_forest")
def _forest(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    return M.score(M.fit_forest(train, FEATURES, TARGET, FOREST), test, "prediction").select(*IDS, "prediction")


@query("mlo4_regressor_chain")
def _chain(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    return _predicted(M.RegressorChain(FEATURES, settings=SMALL).fit(train).transform(test))


@query("mlo5_hybrid_chain")
def _hybrid(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    return _predicted(M.HybridChain(FEATURES, settings=SMALL).fit(train).transform(test))


@query("mlo7_out_of_fold")
def _oof(spark: Spark, sf: str) -> DataFrame:
    folded = cut_lineage(L.assign_folds(_frame(spark, sf), 8, IDS))
    fit = lambda df: M.RegressorChain(FEATURES, TARGETS, FOREST, "standard").fit(df)
    return M.out_of_fold(folded, "fold", 8, fit, "pred_").select(*IDS, "fold", *[q(f"pred_{t}") for t in TARGETS])


@query("mlo9_meta_model")
def _meta_model(spark: Spark, sf: str) -> DataFrame:
    frame = cut_lineage(_frame(spark, sf))
    cols = L.meta_features([q("1_year_rate"), q("3_months_rate"), q("unemployment_rate")])
    meta = frame.select(*IDS, q(TARGET), *[c.alias(n) for n, c in cols.items()])
    fitted = M.fit_meta(meta, list(cols), TARGET, IDS)
    return M.score(fitted.model, L.apply_scale(meta, fitted.scale), "prediction").select(
        *IDS, "prediction", F.lit(fitted.alpha).alias("alpha"))


BASES = {"boosted": M.Trees(trees=2, depth=3, rate=0.5, sample=1.0), "boosted_deep": M.Trees(trees=2, depth=4, rate=0.5, min_leaf=30), "forest": FOREST}


@query("mlo10_stacking")
def _stacking(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    model = M.StackingEnsemble(FEATURES, IDS, BASES, TARGETS[:2], folds=2, alphas=[0.05, 0.5]).fit(train)
    return _predicted(model.transform(test), TARGETS[:2])


@query("mlo11_importance_selection")
def _selection(spark: Spark, sf: str) -> DataFrame:
    return M.select_features(_frame(spark, sf), FEATURES, TARGETS, FOREST, 5, ["CPI", "INDPRO"])


@query("mlo12_feature_elimination")
def _elimination(spark: Spark, sf: str) -> DataFrame:
    frame, parts = cut_lineage(_frame(spark, sf)), []
    for t in TARGETS[:2]:
        parts.append(M.eliminate_features(frame, FEATURES, t, IDS, FOREST, keep=6, folds=2, drop=5).withColumn("target", F.lit(t)))
    return A.rank_scores(parts[0].unionByName(parts[1]))


@query("mlo13_settings_search")
def _search(spark: Spark, sf: str) -> DataFrame:
    grid = [M.Trees(trees=2, depth=dep, rate=rate) for dep in (2, 4) for rate in (0.1, 0.5)]
    return M.search_settings(_frame(spark, sf), FEATURES, TARGET, "date", grid)


@query("mlo13_successive_halving")
def _halving(spark: Spark, sf: str) -> DataFrame:
    return M.search_halving(_frame(spark, sf), FEATURES, TARGET, "date", M.drawn_settings(40, 27)).drop("settings")


@query("mlo14_weighted_ensemble")
def _weighted(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    model = M.StackingEnsemble(FEATURES, IDS, BASES, TARGETS[:1], folds=2, meta="ridge", weighted=True).fit(train)
    return _predicted(model.transform(test), TARGETS[:1])


@query("mlo15_train_and_compare")
def _compare(spark: Spark, sf: str) -> DataFrame:
    metrics, _ = M.train_and_compare(_frame(spark, sf), SPLIT, {
        "full_chain": M.RegressorChain(FEATURES, TARGETS, SMALL), "hybrid": M.HybridChain(FEATURES, TARGETS, SMALL)}, TARGETS)
    return A.compare_models(cut_lineage(metrics), "full_chain", "hybrid")


@query("mlo16_what_if")
def _what_if(spark: Spark, sf: str) -> DataFrame:
    chain = M.RegressorChain(FEATURES, TARGETS, SMALL).fit(cut_lineage(_frame(spark, sf)))
    # The last row of each series with one edited indicator is appended as the next month,
    # and the lags are worked out over the longer panel.
    wide = cut_lineage(economy_targets(spark, sf))
    edited = J.last_row(wide).withColumn("date", F.add_months("date", 1)).withColumn("CPI", q("CPI") * 1.1)
    panel = wide.unionByName(edited.select(*[q(c) for c in wide.columns]))
    for c in ("recession_probability", "CPI", "INDPRO"):
        panel = W.lags(panel, [1], value=c)
    return chain.transform(J.last_row(panel)).select(*IDS, *[percent_to_share(q(f"pred_{t}")).alias(f"share_{t}") for t in TARGETS])


@query("snk5_saved_model")
def _saved(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    path = scratch_path(spark, "model")
    M.RegressorChain(FEATURES, TARGETS, SMALL).fit(train).save(path, spark, note="quarterly refit")
    return _predicted(M.RegressorChain.load(path, spark).transform(test), TARGETS)
