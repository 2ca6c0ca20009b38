"""Learning queries whose models have closed forms: trees without a split, trees of one split on a two-valued column, linear models of one feature. They run
the same operators as `queries_learning`, with all targets, folds and penalties, so that SQL can follow training rows, folds, scaling, chains, storage and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from macrospark.columns import q
from macrospark.constants import META_ALPHAS, TARGET_HORIZONS, TARGETS
from macrospark.functions.scalar import percent_to_share
from macrospark.learning import features as L, models as M
from macrospark.operators import joins as J, windows as W
from macrospark.plans.catalogue import d, query, r
from macrospark.plans.driver_tables import ECONOMY, SPLIT, economy_targets
from macrospark.plans.queries_learning import FEATURES, IDS, TARGET, _frame, _predicted, _sides
from macrospark.session import cut_lineage, scratch_path

EDGE = f"DATE '{SPLIT}'"
#: One tree without a split predicts the mean of its labels.
MEAN = M.Trees(trees=1, depth=0, rate=1.0, sample=1.0)
#: One split: on a two-valued column, the mean of each side; later trees find nothing left.
STUMP = M.Trees(trees=3, depth=1, rate=0.5, sample=1.0)
FOLDS = 8

FRAME = ECONOMY + ", fr AS (SELECT * FROM (SELECT *, " + ", ".join(
    f'lead(recession_probability, {k}) OVER w AS "{t}"' for t, k in TARGET_HORIZONS.items()) + f""", lag(recession_probability) OVER w AS before,
 (month(date) >= 7)::INTEGER AS late, (month(date) % 2)::INTEGER AS odd, date - DATE '1970-01-01' AS day FROM econ WINDOW w AS (PARTITION BY series_id ORDER BY date))
 WHERE before IS NOT NULL AND "{max(TARGET_HORIZONS, key=TARGET_HORIZONS.get)}" IS NOT NULL)"""
_HASH = "md5('42|' || series_id || '|' || strftime(date, '%Y-%m-%d'))"


def _fold(k: int) -> str:
    return f"(row_number() OVER (ORDER BY {_HASH}, series_id, date) - 1) % {k} AS fold"


def _logit(c: str) -> str:
    p = f"greatest(least({c} / 100, 1 - 1e-8::DOUBLE), 1e-8::DOUBLE)"
    return f"ln({p} / (1 - {p}))"


def _back(c: str) -> str:
    return f"(100 / (1 + exp(-({c}))))"


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({"late": (F.month("date") >= 7).cast("double"), "odd": (F.month("date") % 2).cast("double")})


# --- means --------------------------------------------------------------------------------

_MEANS = ", ".join(f'avg({_logit(chr(34) + t + chr(34))}) AS m{i}' for i, t in enumerate(TARGETS))
_CHAIN = f"""WITH {FRAME}, m AS (SELECT {_MEANS} FROM fr WHERE date < {EDGE}) SELECT series_id, {d()}, {', '.join(
    r(_back(f'm{i}'), f'"pred_{t}"') for i, t in enumerate(TARGETS))} FROM fr, m WHERE date >= {EDGE}"""


@query("mlo4_chain_mean", _CHAIN)
def _chain_mean(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    return _predicted(M.RegressorChain(FEATURES, settings=MEAN).fit(train).transform(test))


@query("mlo5_hybrid_mean", _CHAIN)
def _hybrid_mean(spark: Spark, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    return _predicted(M.HybridChain(FEATURES, settings=MEAN).fit(train).transform(test))


@query("snk5_saved_mean", _CHAIN)
def _saved_mean(spark: Spark, sf: str) -> DataFrame:
    """Written, read again, and the read models score."""
    train, test = _sides(spark, sf)
    path = scratch_path(spark, "model")
    M.RegressorChain(FEATURES, settings=MEAN).fit(train).save(path, spark)
    return _predicted(M.RegressorChain.load(path, spark).transform(test))


@query("mlo7_out_of_fold_mean", f"""WITH {FRAME}, fo AS (SELECT *, {_fold(FOLDS)} FROM fr), lg AS (SELECT series_id, date, fold, {', '.join(f'{_logit(chr(34) + t + chr(34))} AS g{i}' for i, t in enumerate(TARGETS))} FROM fo),
 ot AS (SELECT f.fold, {', '.join(f'avg(g{i}) AS m{i}' for i in range(len(TARGETS)))} FROM range({FOLDS}) f(fold) JOIN lg ON lg.fold <> f.fold GROUP BY 1)
 SELECT series_id, {d()}, fold, {', '.join(r(_back(f'm{i}'), f'"pred_{t}"') for i, t in enumerate(TARGETS))} FROM lg JOIN ot USING (fold)""")
def _oof_mean(spark: Spark, sf: str) -> DataFrame:
    """Eight folds, four targets: every row is scored by the mean of the other folds."""
    folded = cut_lineage(L.assign_folds(_frame(spark, sf), FOLDS, IDS))
    scored = M.out_of_fold(folded, "fold", FOLDS, lambda df: M.RegressorChain(FEATURES, settings=MEAN, scaling="standard").fit(df), "pred_")
    return scored.select(*IDS, "fold", *[q(f"pred_{t}") for t in TARGETS])


@query("mlo16_what_if_mean", f"""WITH {FRAME}, m AS (SELECT {_MEANS} FROM fr), z AS (SELECT series_id, max(date) AS last FROM econ GROUP BY 1 HAVING count(*) > 1)
 SELECT series_id, strftime(last + INTERVAL 1 MONTH, '%Y-%m-%d') AS date, {', '.join(r(_back(f'm{i}') + ' / 100', f'"share_{t}"') for i, t in enumerate(TARGETS))} FROM z, m""")
def _what_if_mean(spark: Spark, sf: str) -> DataFrame:
    """An edited month after the last of each series, with lags taken from the longer panel (a series of one row has none)."""
    chain = M.RegressorChain(FEATURES, settings=MEAN).fit(cut_lineage(_frame(spark, sf)))
    wide = cut_lineage(economy_targets(spark, sf))
    edited = J.last_row(wide).withColumn("date", F.add_months("date", 1)).withColumn("CPI", q("CPI") * 1.1)
    panel = wide.unionByName(edited.select(*[q(c) for c in wide.columns]))
    for c in ("recession_probability", "CPI", "INDPRO"):
        panel = W.lags(panel, [1], value=c)
    return chain.transform(J.last_row(panel).filter(q("CPI_lag1").isNotNull())).select(*IDS, *[percent_to_share(q(f"pred_{t}")).alias(f"share_{t}") for t in TARGETS])


@query("mlo15_compare_mean", f"""WITH {FRAME}, m AS (SELECT {_MEANS} FROM fr WHERE date < {EDGE}), e AS ({' UNION ALL '.join(
    f'SELECT {chr(39)}{t}{chr(39)} AS target, "{t}" AS actual, {_back(f"m{i}")} AS forecast FROM fr, m WHERE date >= {EDGE}' for i, t in enumerate(TARGETS))}),
 s AS (SELECT target, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, max(abs(actual - forecast)) AS max_error FROM e GROUP BY 1)
 SELECT target, architecture, {r('mae', digits=3)}, {r('rmse', digits=3)}, {r('max_error', digits=3)} FROM s, (VALUES ('chain'), ('hybrid')) a(architecture)""", 3)
def _compare_mean(spark: Spark, sf: str) -> DataFrame:
    metrics, _ = M.train_and_compare(_frame(spark, sf), SPLIT, {"chain": M.RegressorChain(FEATURES, settings=MEAN), "hybrid": M.HybridChain(FEATURES, settings=MEAN)}, TARGETS)
    return metrics.select("target", "architecture", "mae", "rmse", "max_error")


# --- one split --------------------------------------------------------------------------------

@query("mlo2_boosted_groups", f"""WITH {FRAME}, tr AS (SELECT * FROM fr WHERE date < {EDGE}), cu AS (SELECT floor(quantile_cont(day, 0.9)) AS cut FROM tr),
 m AS (SELECT late, avg("{TARGET}") AS prediction FROM tr, cu WHERE day <= cut GROUP BY 1) SELECT series_id, {d()}, {r('prediction')} FROM fr JOIN m USING (late) WHERE date >= {EDGE}""")
def _boosted_groups(spark: Spark, sf: str) -> DataFrame:
    """Boosting on one two-valued column, the newest tenth of the training rows kept for early stopping."""
    train, test = _sides(spark, sf)
    return M.score(M.fit_boosted(_marked(train), ["late"], TARGET, "date", STUMP), _marked(test), "prediction").select(*IDS, "prediction")


@query("mlo3_forest_range", f"""WITH {FRAME} SELECT series_id, count(*) AS n, count(*) AS inside FROM fr WHERE date >= {EDGE} GROUP BY 1""")
def _forest_range(spark: Spark, sf: str) -> DataFrame:
    """Leaves are means of training labels, so a forest stays between the least and the greatest of them."""
    train, test = _sides(spark, sf)
    ends = train.agg(F.min(q(TARGET)).alias("_low"), F.max(q(TARGET)).alias("_high"))
    forest = M.fit_forest(train, FEATURES, TARGET, M.Trees(kind="forest", trees=20, depth=6, min_leaf=5))
    scored = M.score(forest, test, "prediction").select("series_id", "prediction").crossJoin(F.broadcast(ends))
    return scored.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prediction").between(F.col("_low") - 1e-9, F.col("_high") + 1e-9), 1)).alias("inside"))


@query("mlo13_search_groups", f"""WITH {FRAME}, cu AS (SELECT floor(quantile_cont(day, 0.8)) AS cut FROM fr), tr AS (SELECT * FROM fr, cu WHERE day <= cut), te AS (SELECT * FROM fr, cu WHERE day > cut),
 a AS (SELECT avg("{TARGET}") AS m FROM tr), b AS (SELECT late, avg("{TARGET}") AS m FROM tr GROUP BY 1)
 SELECT 0::BIGINT AS config, {r(f'sqrt(avg(("{TARGET}" - m) ** 2))', 'rmse')} FROM te, a UNION ALL
 SELECT config::BIGINT, {r(f'sqrt(avg(("{TARGET}" - m) ** 2))', 'rmse')} FROM te JOIN b USING (late), range(1, 3) t(config) GROUP BY 1""")
def _search_groups(spark: Spark, sf: str) -> DataFrame:
    grid = [MEAN, M.Trees(**{**STUMP.__dict__, "trees": 1}), STUMP]
    return M.search_settings(_marked(_frame(spark, sf)), ["late"], TARGET, "date", grid).select("config", "rmse")


@query("mlo13_halving_groups", f"""WITH {FRAME}, cu AS (SELECT floor(quantile_cont(day, 0.8)) AS cut FROM fr), tr AS (SELECT * FROM fr, cu WHERE day <= cut), te AS (SELECT * FROM fr, cu WHERE day > cut),
 a AS (SELECT avg("{TARGET}") AS m FROM tr), b AS (SELECT late, avg("{TARGET}") AS m FROM tr GROUP BY 1), ea AS (SELECT sqrt(avg(("{TARGET}" - m) ** 2)) AS e FROM te, a),
 eb AS (SELECT sqrt(avg(("{TARGET}" - m) ** 2)) AS e FROM te JOIN b USING (late)), e AS (SELECT ea.e AS ea, eb.e AS eb, CASE WHEN eb.e < ea.e THEN 1 ELSE 0 END AS w FROM ea, eb)
 SELECT 0::BIGINT AS round, config::BIGINT AS config, 1::BIGINT AS trees, {r('CASE WHEN config = 0 THEN ea ELSE eb END', 'rmse')}, config = w AS kept FROM e, range(3) t(config)
 UNION ALL SELECT 1, w, 3, {r('least(ea, eb)', 'rmse')}, true FROM e""")
def _halving_groups(spark: Spark, sf: str) -> DataFrame:
    grid = [M.Trees(trees=3, depth=0, sample=1.0), M.Trees(trees=3, depth=1, rate=0.5, sample=1.0), M.Trees(trees=3, depth=1, rate=0.1, sample=1.0)]
    return M.search_halving(_marked(_frame(spark, sf)), ["late"], TARGET, "date", grid).drop("settings")


# --- selection with a known answer -----------------------------------------------------------------

_ALL = ["late", "odd", *FEATURES]
_SURE = M.Trees(kind="forest", trees=5, depth=3, sample=1.0, columns="all")


def _known(spark: Spark, sf: str) -> DataFrame:
    """Labels that one column alone decides."""
    return _marked(_frame(spark, sf)).withColumns({"by_late": 20.0 + 60.0 * F.col("late"), "by_odd": 30.0 + 40.0 * F.col("odd")})


_RANKED = "SELECT target, feature, CASE WHEN 'by_' || feature = target THEN 1.0::DOUBLE ELSE 0.0 END AS importance FROM (VALUES ('by_late'), ('by_odd')) t(target), (VALUES " + ", ".join(f"('{f}')" for f in _ALL) + ") f(feature)"


@query("mlo11_known_selection", f"""WITH k AS ({_RANKED}), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY importance DESC, feature) AS rank FROM k)
 SELECT target, feature, importance, rank, rank <= 5 OR feature IN ('CPI', 'INDPRO') AS selected FROM o""")
def _known_selection(spark: Spark, sf: str) -> DataFrame:
    return M.select_features(_known(spark, sf), _ALL, ["by_late", "by_odd"], _SURE, 5, ["CPI", "INDPRO"])


_FEW = ["late", "odd", "CPI", "INDPRO", "PPI", "CSI_index"]


@query("mlo12_known_elimination", f"""SELECT feature, row_number() OVER (ORDER BY feature <> 'late', feature) AS rank, feature = 'late' AS selected FROM (VALUES {', '.join(f"('{f}')" for f in _FEW)}) f(feature)""")
def _known_elimination(spark: Spark, sf: str) -> DataFrame:
    """All sets that hold the deciding column score alike, so the smallest is taken; the others go in the order of their names, the last first."""
    return M.eliminate_features(_known(spark, sf), _FEW, "by_late", IDS, _SURE, keep=1)


# --- linear models of one feature -----------------------------------------------------------------

_X = "1_year_rate"
_SCALED = f"""sc AS (SELECT avg("{_X}") AS mx, stddev_pop("{_X}") AS sx FROM fr), st AS (SELECT series_id, date, ("{_X}" - mx) / sx AS x, "{TARGET}" AS y, {_fold(3)} FROM fr, sc)"""


@query("mlo14_ridge_one", f"""WITH {FRAME}, {_SCALED}, co AS (SELECT avg(y) AS my, sum(x * (y - m)) / (sum(x * x) + 10.0::DOUBLE * any_value(sd)) AS b FROM st, (SELECT avg(y) AS m, stddev_pop(y) / stddev_samp(y) AS sd FROM st) GROUP BY ALL)
 SELECT series_id, {d()}, {r('my + b * x', 'prediction', 3)} FROM st, co""".replace(" GROUP BY ALL", ""), 3)
def _ridge_one(spark: Spark, sf: str) -> DataFrame:
    frame = cut_lineage(_frame(spark, sf))
    fitted = M.fit_ridge(frame, [_X], TARGET, 10.0)
    return M.score(fitted.model, L.apply_scale(frame, fitted.scale), "prediction").select(*IDS, "prediction")


_SHRUNK = "sign(c) * greatest(abs(c) - alpha / 2, 0) / (v + alpha / 2 * whole / own)"


@query("mlo9_elastic_one", f"""WITH {FRAME}, {_SCALED}, al AS (SELECT unnest({META_ALPHAS}::DOUBLE[]) AS alpha), al2 AS (SELECT alpha, row_number() OVER (ORDER BY alpha) AS i FROM al), sd AS (SELECT stddev_pop(y) AS whole FROM st),
 tr AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v, stddev_samp(y) AS own FROM range(-1, 3) f(fold) JOIN st ON st.fold <> f.fold GROUP BY 1),
 w AS (SELECT fold, i, alpha, mx, my, {_SHRUNK} AS b FROM tr, al2, sd), sco AS (SELECT fold, i, 1 - sum((y - my - b * (x - mx)) ** 2) / (count(*) * var_pop(y)) AS s FROM st JOIN w USING (fold) GROUP BY 1, 2),
 best AS (SELECT i FROM sco GROUP BY 1 ORDER BY round(avg(s), 9) DESC, i LIMIT 1)
 SELECT series_id, {d()}, {r('my + b * (x - mx)', 'prediction', 2)}, alpha FROM st, (SELECT w.* FROM w JOIN best USING (i) WHERE fold = -1) z""", 2)
def _elastic_one(spark: Spark, sf: str) -> DataFrame:
    """Six penalties, three folds: the penalty with the best mean R2, and its predictions."""
    frame = cut_lineage(_frame(spark, sf))
    fitted = M.fit_meta(frame, [_X], TARGET, IDS)
    return M.score(fitted.model, L.apply_scale(frame, fitted.scale), "prediction").select(*IDS, "prediction", F.lit(fitted.alpha).alias("alpha"))
