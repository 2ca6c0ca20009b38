"""Trees, regressor chains and the stacking ensemble (MLO2-MLO5, MLO7, MLO9-MLO16).

Every fit is a pyspark.ml fit over the whole distributed frame. A frame that
several fits read is written to the shared checkpoint folder once (`cut_lineage`),
so a lost executor does not replay the feature windows. A tree fit reads its rows several times before
it holds them itself; where they are costly, `fit_kept` writes its vectors once."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macrospark.columns import Names, q
from macrospark.constants import META_ALPHAS, TARGETS
from macrospark.functions.scalar import clip, safe_inverse_logit, safe_logit
from macrospark.learning.features import (
    Scale, apply_scale, assign_folds, fit_robust, fit_standard, meta_features, tail_flag,
)
from macrospark.operators.stats import forecast_metrics, quartile_bins, r2, rmse
from macrospark.session import cut_lineage

WEIGHT = "sample_weight"



def assembled(features: Sequence[str], label: str, regressor) -> Pipeline:
    vector = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    return Pipeline(stages=[vector, regressor.setFeaturesCol("_features").setLabelCol(label)
                            .setPredictionCol("_prediction")])


def needed(pipeline: Pipeline) -> list[str]:
    """Columns that the last stage of `assembled` reads."""
    net = pipeline.getStages()[-1]
    used = [net.getFeaturesCol(), net.getLabelCol()]
    for name in ("weightCol", "validationIndicatorCol"):
        if net.hasParam(name) and net.isDefined(name):
            used.append(net.getOrDefault(name))
    return used


def fit_kept(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """`pipeline.fit(df)` of an `assembled` one whose vectors are put together and written once, as the fit reads them several times. They
    stand in the partitions in which the fit would have met them, so its draws of rows are the same."""
    vector, net = pipeline.getStages()
    rows = cut_lineage(vector.transform(df).select(*[q(c) for c in needed(pipeline)]))
    return PipelineModel([vector, net.fit(rows)])


@dataclass(frozen=True)
class Trees:
    """Settings of a tree family. `kind` is boosted or forest."""
    kind: str = "boosted"
    trees: int = 100
    depth: int = 6
    rate: float = 0.05
    sample: float = 0.8
    min_leaf: int = 1
    columns: str = "auto"
    seed: int = 42
    weighted: bool = False
    validation: bool = False

    def build(self, features: Sequence[str], label: str) -> Pipeline:
        if self.kind == "boosted":
            model = GBTRegressor(maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate,
                                 subsamplingRate=self.sample, minInstancesPerNode=self.min_leaf, seed=self.seed)
            if self.validation:
                model = model.setValidationIndicatorCol("is_validation")
        elif self.kind == "forest":
            model = RandomForestRegressor(numTrees=self.trees, maxDepth=self.depth, subsamplingRate=self.sample,
                                          minInstancesPerNode=self.min_leaf, featureSubsetStrategy=self.columns,
                                          seed=self.seed)
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.weighted:
            model = model.setWeightCol(WEIGHT)
        return assembled(features, label, model)


# Full-size base models: two boosted ensembles and a forest.
DEFAULT_BASES = {
    "boosted": Trees(trees=600, depth=6, rate=0.05),
    "boosted_deep": Trees(trees=500, depth=8, rate=0.05, min_leaf=30, validation=True),
    "forest": Trees(kind="forest", trees=500, depth=12, min_leaf=5, columns="0.8"),
}


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, order: str, settings: Trees = Trees(),
    validation: float = 0.1,
) -> PipelineModel:
    """MLO2: boosted trees that stop early on the newest rows."""
    flagged = tail_flag(df, order, validation)
    return Trees(**{**settings.__dict__, "validation": True}).build(features, label).fit(flagged)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, settings: Trees) -> PipelineModel:
    """MLO3."""
    return Trees(**{**settings.__dict__, "kind": "forest"}).build(features, label).fit(df)


def score(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    """MLO16: one prediction column; inputs are kept."""
    return model.transform(df).drop("_features").withColumnRenamed("_prediction", output)


# --- chain (MLO4) --------------------------------------------------------------

@dataclass
class RegressorChain:
    """One model per target in log-odds space; each also sees the earlier targets: the
    true ones in training, the predicted ones afterwards."""
    features: list[str]
    targets: list[str] = field(default_factory=lambda: list(TARGETS))
    settings: Trees = Trees()
    scaling: str = "robust"
    order: str = "date"
    scale: Scale = field(default_factory=dict)
    models: list[PipelineModel] = field(default_factory=list)

    def _link(self, i: int) -> str:
        return f"_chain_{i}"

    def fit(self, df: DataFrame) -> "RegressorChain":
        self.scale = (fit_robust if self.scaling == "robust" else fit_standard)(df, self.features)
        train = apply_scale(df, self.scale).withColumns(
            {self._link(i): safe_logit(q(t)) for i, t in enumerate(self.targets)})
        if self.settings.validation:
            train = tail_flag(train, self.order, 0.1)
        train = cut_lineage(train)
        self.models = [
            self.settings.build([*self.features, *[self._link(j) for j in range(i)]], self._link(i)).fit(train)
            for i in range(len(self.targets))]
        return self

    def transform(self, df: DataFrame, prefix: str = "pred_") -> DataFrame:
        """Input rows with one prediction per target, in percent within [0, 100]."""
        kept = [q(c) for c in df.columns]
        out = apply_scale(df.select(*kept, *[q(c).alias(f"_raw_{c}") for c in self.features]), self.scale)
        for i, model in enumerate(self.models):
            out = score(model, out, self._link(i))
        restored = [q(f"_raw_{c}").alias(c) if c in self.features else q(c) for c in df.columns]
        return out.select(*restored, *[
            safe_inverse_logit(q(self._link(i))).alias(f"{prefix}{t}") for i, t in enumerate(self.targets)])

    def save(self, path: str, spark: SparkSession, **metadata: str) -> None:
        """SNK5: the stage models and one metadata row."""
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/stage_{i}")
        info = {"features": self.features, "targets": self.targets, "scaling": self.scaling, "order": self.order,
                "scale": {k: list(v) for k, v in self.scale.items()}, "settings": self.settings.__dict__,
                "metadata": metadata}
        spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "RegressorChain":
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        return cls(features=info["features"], targets=info["targets"], settings=Trees(**info["settings"]),
                   scaling=info["scaling"], order=info["order"],
                   scale={k: tuple(v) for k, v in info["scale"].items()},
                   models=[PipelineModel.load(f"{path}/stage_{i}") for i in range(len(info["targets"]))])


@dataclass
class HybridChain:
    """MLO5: a chain over the first targets and one more model for the last target that
    takes the chain's predictions in percent."""
    features: list[str]
    targets: list[str] = field(default_factory=lambda: list(TARGETS))
    settings: Trees = Trees()
    scaling: str = "robust"
    chain: RegressorChain | None = None
    last: RegressorChain | None = None

    def _fed(self, df: DataFrame) -> DataFrame:
        assert self.chain is not None
        return self.chain.transform(df, "fed_")

    def fit(self, df: DataFrame) -> "HybridChain":
        self.chain = RegressorChain(self.features, self.targets[:-1], self.settings, self.scaling).fit(df)
        fed = [f"fed_{t}" for t in self.targets[:-1]]
        self.last = RegressorChain([*self.features, *fed], self.targets[-1:], self.settings, self.scaling).fit(self._fed(df))
        return self

    def transform(self, df: DataFrame, prefix: str = "pred_") -> DataFrame:
        assert self.last is not None
        out = self.last.transform(self._fed(df), prefix)
        return out.withColumnsRenamed({f"fed_{t}": f"{prefix}{t}" for t in self.targets[:-1]})


# --- stacking (MLO7, MLO9, MLO10) -----------------------------------------------

def together(spark: SparkSession, jobs: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Independent fits from a few driver threads, as CrossValidator does, so that the
    cluster is not idle between the many small jobs of one fit. Each job is wrapped by itself: the
    wrapper's copy of the local properties must not be shared between threads."""
    wrapped = [inheritable_thread_target(spark)(job) for job in jobs]
    pool = ThreadPool(min(parallelism, max(len(jobs), 1)))
    try:
        return pool.map(lambda job: job(), wrapped)
    finally:
        pool.terminate()


def out_of_fold(
    df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], "RegressorChain"], prefix: str, parallelism: int = 4
) -> DataFrame:
    """MLO7: each fold scored by a model that did not see it."""
    def job(i: int) -> Callable[[], object]:
        return lambda: fit(df.filter(q(fold) != i))

    models = together(df.sparkSession, [job(i) for i in range(k)], parallelism)
    return reduce(DataFrame.unionByName, [m.transform(df.filter(q(fold) == i), prefix) for i, m in enumerate(models)])


@dataclass
class MetaModel:
    scale: Scale
    model: PipelineModel
    alpha: float
    score: float


def penalty(alpha: float, l1_ratio: float, label_std: float) -> tuple[float, float]:
    """regParam and elasticNetParam for the penalty alpha * (l1_ratio * |w| + (1 - l1_ratio)
    / 2 * w^2) on half the mean squared error. LinearRegression divides regParam by
    the label's std, which is right for the L1 part only; the L2 part is scaled back."""
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio) * label_std
    return l1 + l2, (l1 / (l1 + l2) if l1 + l2 > 0 else 0.0)


def label_std(df: DataFrame, target: str) -> float:
    return df.agg(F.stddev_pop(q(target))).first()[0] or 1.0


def fit_meta(
    df: DataFrame, features: Sequence[str], target: str, ids: Names, alphas: Sequence[float] = tuple(META_ALPHAS),
    folds: int = 3, parallelism: int = 3,
) -> MetaModel:
    """MLO9: elastic net (half L1) on standardized meta-features; the penalty with the
    best mean R2 over plain folds."""
    scale = fit_standard(df, features)
    train = cut_lineage(assign_folds(apply_scale(df, scale), folds, ids, output="_fold"))
    net = LinearRegression(maxIter=200, standardization=False)
    pipeline = assembled(features, target, net)
    settings = [penalty(a, 0.5, label_std(train, target)) for a in alphas]
    grid = [{net.regParam: reg, net.elasticNetParam: mix} for reg, mix in settings]
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, numFolds=folds, foldCol="_fold", parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=target, predictionCol="_prediction", metricName="r2")).fit(train)
    best = max(range(len(alphas)), key=lambda i: (search.avgMetrics[i], -i))
    return MetaModel(scale, search.bestModel, list(alphas)[best], search.avgMetrics[best])


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0) -> MetaModel:
    """MLO14: ridge meta model with the penalty alpha * |w|^2 on the sum of squares."""
    scale = fit_standard(df, features)
    train = apply_scale(df, scale)
    reg, mix = penalty(alpha / max(df.count(), 1), 0.0, label_std(df, target))
    net = LinearRegression(elasticNetParam=mix, regParam=reg, standardization=False)
    return MetaModel(scale, assembled(features, target, net).fit(train), alpha, float("nan"))


def high_value_weight(target: Column, strength: float = 3.0) -> Column:
    """MLO14: exponential weight, higher for rare high percentages."""
    return F.exp(F.lit(strength) * clip(target, 0.0, 100.0) / 100.0)


@dataclass
class StackingEnsemble:
    """MLO10: base chains, out-of-fold meta-features, one linear model per target."""
    features: list[str]
    ids: list[str]
    bases: Mapping[str, Trees] = field(default_factory=lambda: dict(DEFAULT_BASES))
    targets: list[str] = field(default_factory=lambda: list(TARGETS))
    folds: int = 8
    alphas: Sequence[float] = tuple(META_ALPHAS)
    meta: str = "elastic"
    weighted: bool = False
    parallelism: int = 4
    fitted: dict[str, RegressorChain] = field(default_factory=dict)
    metas: dict[str, MetaModel] = field(default_factory=dict)

    def _base(self, name: str) -> Callable[[DataFrame], RegressorChain]:
        settings = self.bases[name]
        if self.weighted:
            settings = Trees(**{**settings.__dict__, "weighted": True})
        scaling = "standard" if settings.kind == "forest" else "robust"
        return lambda df: RegressorChain(self.features, self.targets, settings, scaling).fit(df)

    def _meta_columns(self, target: str) -> dict[str, Column]:
        cols = meta_features([q(f"{name}_{target}") for name in self.bases])
        return {f"_m_{n}": c for n, c in cols.items()}

    def fit(self, df: DataFrame) -> "StackingEnsemble":
        base_target = self.targets[0]
        if self.weighted:
            df = df.withColumn(WEIGHT, high_value_weight(q(base_target)))
        folded = cut_lineage(assign_folds(quartile_bins(df, base_target, "_bin"), self.folds, self.ids, "_bin"))
        spark = df.sparkSession
        # One fit per base and training set: the whole frame, and each frame less a fold.
        sets = [(name, fold) for name in self.bases for fold in (None, *range(self.folds))]

        def job(name: str, fold: int | None) -> Callable[[], object]:
            return lambda: self._base(name)(folded if fold is None else folded.filter(q("fold") != fold))

        models = dict(zip(sets, together(spark, [job(*s) for s in sets], self.parallelism)))
        self.fitted = {name: models[name, None] for name in self.bases}
        # A fold's rows pass through the models of all bases, so no join is needed.
        parts = []
        for fold in range(self.folds):
            part = folded.filter(q("fold") == fold)
            for name in self.bases:
                part = models[name, fold].transform(part, f"{name}_")
            parts.append(part)
        scored = cut_lineage(reduce(DataFrame.unionByName, parts))

        def meta(t: str) -> Callable[[], object]:
            cols = self._meta_columns(t)
            frame = scored.select(*[q(c) for c in self.ids], q(t), *[c.alias(n) for n, c in cols.items()])
            if self.meta == "elastic":
                return lambda: fit_meta(frame, list(cols), t, self.ids, self.alphas)
            return lambda: fit_ridge(frame, list(cols), t)

        self.metas = dict(zip(self.targets, together(spark, [meta(t) for t in self.targets], self.parallelism)))
        return self

    def transform(self, df: DataFrame, prefix: str = "pred_") -> DataFrame:
        out = df
        for name, chain in self.fitted.items():
            out = chain.transform(out, f"{name}_")
        for t in self.targets:
            out = out.withColumns(self._meta_columns(t))
            meta = self.metas[t]
            out = score(meta.model, apply_scale(out, meta.scale), f"{prefix}{t}").drop(*self._meta_columns(t))
            out = out.withColumn(f"{prefix}{t}", clip(q(f"{prefix}{t}"), 0.0, 100.0))
        return out.drop(*[f"{name}_{t}" for name in self.bases for t in self.targets])


# --- selection and search (MLO11-MLO13) -----------------------------------------

def importances(
    df: DataFrame, features: Sequence[str], target: str, settings: Trees
) -> DataFrame:
    """MLO11: (feature, importance, rank) of a forest; one row per feature."""
    forest = fit_forest(df, features, target, settings).stages[-1]
    weights = forest.featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-weights[i], features[i]))
    rows = [(features[i], float(weights[i]), r + 1) for r, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int")


def select_features(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], settings: Trees, k: int = 30,
    mandatory: Sequence[str] = (),
) -> DataFrame:
    """MLO11: per target its top k features; mandatory ones are always selected."""
    df = cut_lineage(df)

    def job(t: str) -> Callable[[], object]:
        return lambda: importances(df.filter(q(t).isNotNull()), features, t, settings)

    found = together(df.sparkSession, [job(t) for t in targets], 4)
    chosen = (F.col("rank") <= k) | F.col("feature").isin(list(mandatory))
    return reduce(DataFrame.unionByName, [
        part.withColumn("target", F.lit(t)).withColumn("selected", chosen) for t, part in zip(targets, found)])


def eliminate_features(
    df: DataFrame, features: Sequence[str], target: str, ids: Names, settings: Trees, keep: int = 5, folds: int = 3,
    drop: int = 1,
) -> DataFrame:
    """MLO12: recursive elimination. Each round scores the current set by mean R2 over
    folds and drops the weakest features; the best-scoring round is the selection.
    Returns (feature, rank, selected): rank 1 for selected, then by order of loss."""
    data = cut_lineage(assign_folds(df.filter(q(target).isNotNull()), folds, ids, output="_fold"))
    current, rounds, lost = list(features), [], []
    while True:
        fits = together(df.sparkSession, [
            (lambda i=i: fit_forest(data.filter(F.col("_fold") != i), current, target, settings)) for i in range(folds)], 4)
        preds = [score(m, data.filter(F.col("_fold") == i), "_p").select("_fold", q(target).alias("_y"), "_p")
                 for i, m in enumerate(fits)]
        value = (reduce(DataFrame.unionByName, preds).groupBy("_fold").agg(r2(F.col("_y"), F.col("_p")).alias("s"))
                 .agg(F.avg("s")).first()[0])
        rounds.append((value if value is not None else float("-inf"), list(current)))
        if len(current) <= keep:
            break
        weak = [r["feature"] for r in importances(data, current, target, settings)
                .orderBy(F.desc("rank")).limit(min(drop, len(current) - keep)).collect()]
        lost.append(weak)
        current = [c for c in current if c not in weak]
    chosen = max(rounds, key=lambda x: (x[0], -len(x[1])))[1]
    rank, rows = 1, [(c, 1, True) for c in chosen]
    for weak in reversed(lost):
        gone = [c for c in weak if c not in chosen]
        if gone:
            rank += 1
            rows += [(c, rank, False) for c in gone]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean")


def search_settings(
    df: DataFrame, features: Sequence[str], target: str, order: str, grid: Sequence[Trees], tail: float = 0.2
) -> DataFrame:
    """MLO13: each configuration fitted on the older rows and scored (RMSE) on the
    newest; one row per configuration, best first."""
    flagged = cut_lineage(tail_flag(df.filter(q(target).isNotNull()), order, tail, "_tail"))
    train, test = flagged.filter(~F.col("_tail")), flagged.filter("_tail")
    rows = []
    for i, settings in enumerate(grid):
        model = settings.build(features, target).fit(train)
        error = score(model, test, "_p").agg(rmse(q(target), F.col("_p"))).first()[0]
        rows.append((i, json.dumps(settings.__dict__), float(error)))
    return df.sparkSession.createDataFrame(rows, "config int, settings string, rmse double").orderBy("rmse", "config")


def drawn_settings(n: int, trees: int, seed: int = 42) -> list[Trees]:
    """`n` settings of boosted trees spread evenly over depth, rate (by its logarithm), row share and leaf size: points of an additive
    recurrence, each dimension with its own irrational step, shifted by the seed."""
    root = reduce(lambda x, _: (1 + x) ** (1 / 5), range(60), 1.0)  # of x^5 = x + 1: steps for four dimensions
    place = lambda i, d: ((seed * 0.618034 + (i + 1) / root ** (d + 1)) % 1.0)
    return [Trees(trees=trees, depth=2 + int(place(i, 0) * 6), rate=round(0.02 * 15 ** place(i, 1), 4),
                  sample=round(0.5 + place(i, 2) / 2, 3), min_leaf=1 + int(place(i, 3) * 30)) for i in range(n)]


def search_halving(
    df: DataFrame, features: Sequence[str], target: str, order: str, settings: Sequence[Trees], tail: float = 0.2,
    start: int = 1, factor: int = 3, parallelism: int = 4,
) -> DataFrame:
    """MLO13 by successive halving: all settings are fitted with `start` trees on the older rows and scored (RMSE) on the newest; the
    best 1 / `factor` of them go on with `factor` times as many trees, until the last have all of their own. The fits of a
    round run beside each other. One row per fit: round, config, trees, settings, rmse, kept (went on, or came first in
    the last round; ties to the first config). The winner is the row with `kept` in the last round.

    Every round fits and scores on all rows; only the number of trees grows. A setting that is slow to learn may go out early, which is
    the price of the method: `search_settings` fits them all in full."""
    if not settings or start < 1 or factor < 2:
        raise ValueError("needs settings, a start of at least one tree and a factor of at least two")
    spark = df.sparkSession
    flagged = cut_lineage(tail_flag(df.filter(q(target).isNotNull()), order, tail, "_tail"))
    train, test = flagged.filter(~F.col("_tail")), flagged.filter("_tail")

    def fitted(setting: Trees) -> float:
        model = setting.build(features, target).fit(train)
        return float(score(model, test, "_p").agg(rmse(q(target), F.col("_p"))).first()[0])

    alive, turn, rows = list(range(len(settings))), 0, []
    while True:
        now = [Trees(**{**settings[i].__dict__, "trees": min(start * factor ** turn, settings[i].trees)}) for i in alive]
        errors = together(spark, [(lambda s=s: fitted(s)) for s in now], parallelism)
        last = all(s.trees == settings[i].trees for i, s in zip(alive, now))
        keep = 1 if last else math.ceil(len(alive) / factor)
        best = {i for _, i in sorted(zip(errors, alive))[:keep]}
        rows += [(turn, i, s.trees, json.dumps(s.__dict__), e, i in best) for i, s, e in zip(alive, now, errors)]
        if last:
            break
        alive, turn = [i for i in alive if i in best], turn + 1
    return (spark.createDataFrame(rows, "round int, config int, trees int, settings string, rmse double, kept boolean")
            .orderBy(F.desc("round"), "rmse", "config"))


# --- training driver (MLO15) ------------------------------------------------------

def evaluate(df: DataFrame, targets: Sequence[str], prefix: str = "pred_") -> DataFrame:
    """Metrics per target of a frame that holds targets and predictions."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), q(t).alias("actual"), q(f"{prefix}{t}").alias("forecast"))
                      for t in targets])
    long = df.select(F.inline(pairs)).filter("actual is not null and forecast is not null")
    return forecast_metrics(long, "target")


def train_and_compare(
    df: DataFrame, split: str, models: Mapping[str, object], targets: Sequence[str], order: str = "date"
) -> tuple[DataFrame, dict[str, object]]:
    """MLO15: fit each model on rows before the split, evaluate on the rest. Returns the
    metrics (architecture, target, ...) and the fitted models."""
    from macrospark.operators.clean import split_at

    train, test = split_at(df, split, order)
    train, test = cut_lineage(train), cut_lineage(test)
    found = together(df.sparkSession, [(lambda m=m: m.fit(train)) for m in models.values()], 4)
    fitted = dict(zip(models, found))
    parts = [evaluate(m.transform(test), targets).withColumn("architecture", F.lit(n)) for n, m in fitted.items()]
    return reduce(DataFrame.unionByName, parts), fitted


