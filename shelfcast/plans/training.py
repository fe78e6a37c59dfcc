"""Model training, tuning and backtests.

The assembled matrix is stored once; folds and slices are filters on it. Trees with a Tweedie or
pinball loss do not exist in MLlib: ``fit_learners`` and ``boosted_backtest`` train them with the
histogram booster of ``plans.boosting``, all models or folds in one pass. The MLlib models are a
Tweedie GLM, squared-loss boosted trees and a random forest, whose bands are holdout residual
quantiles added to the point forecast.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, replace
from datetime import date
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators import bands, evaluation
from shelfcast.operators.cleaning import fill_features
from shelfcast.operators.features import LAGS, require_daily_grain
from shelfcast.operators.profile import feature_columns, require_rows
from shelfcast.plans import boosting
from shelfcast.plans.durable import durable
from shelfcast.plans.features import engineer
from shelfcast.plans.folds import Fold, expanding_folds, label_slices, rolling_folds, split_dates

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"

# Search ranges of the boosted-tree settings that MLlib has. featureSubsetStrategy is the
# share of columns, minInstancesPerNode the least rows of a leaf, minInfoGain the least gain of a split.
SEARCH_RANGES = {
    "maxIter": (100, 2000),
    "maxDepth": (3, 10),
    "stepSize": (0.01, 0.3),
    "subsamplingRate": (0.6, 1.0),
    "featureSubsetStrategy": (0.6, 1.0),
    "minInstancesPerNode": (1, 7),
    "minInfoGain": (0.0, 0.4),
}
TRIALS = 50

# Rounds of boosting, ended early on the stop slice; trees of the forest.
ROUNDS = 1_000
FOREST_TREES = 100
SLICES = ("train", "stop", "calibrate", "report")
PARALLEL_FITS = 4
STOP_SHARE = 0.15


# estimators ----------------------------------------------------------------------------------


def tweedie_glm(variance_power: float = 1.2, reg: float = 0.01, max_iter: int = 25) -> Estimator:
    """Generalised linear model with a Tweedie variance and a log link."""
    return GeneralizedLinearRegression(
        family="tweedie", variancePower=variance_power, linkPower=0.0, regParam=reg, maxIter=max_iter,
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION,
    )


class SeriesMean(Estimator):
    """Baseline: the mean of the series, 0 for a series without rows."""

    def __init__(self, cols: PanelColumns = PANEL):
        super().__init__()
        self.cols = cols

    def _fit(self, dataset: DataFrame) -> SeriesMeanModel:
        return SeriesMeanModel(durable(dataset.groupBy(*self.cols.series).agg(F.avg(LABEL).alias("_mean"))), self.cols)


class SeriesMeanModel(Model):
    """Fitted means, one row per series."""

    def __init__(self, means: DataFrame, cols: PanelColumns = PANEL):
        super().__init__()
        self.means, self.cols = means, cols

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = dataset.join(self.means, list(self.cols.series), "left")
        return found.withColumn(PREDICTION, F.coalesce(F.col("_mean"), F.lit(0.0))).drop("_mean")


def boosted_trees(validation: str | None = None, **settings) -> Estimator:
    """Squared-loss boosted trees; with a validation column they stop early."""
    chosen = {"maxIter": ROUNDS, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, **settings}
    if validation:
        chosen["validationIndicatorCol"] = validation
    return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **chosen)


def random_forest(**settings) -> Estimator:
    """Second tree learner of the ensemble."""
    chosen = {"numTrees": FOREST_TREES, "maxDepth": 6, "subsamplingRate": 0.8, "seed": 42, **settings}
    return RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **chosen)


# matrix --------------------------------------------------------------------------------------


MODEL_WINDOWS = (7, 30)


def model_lags(horizon: int) -> list[int]:
    """Lags that are known ``horizon`` rows ahead."""
    return [k for k in LAGS if k >= horizon] or [horizon]


def gap_columns(wide: DataFrame, cols: PanelColumns = PANEL) -> list[str]:
    """Features that can be missing: lags, rolling figures and index features."""
    return [c for c in feature_columns(wide, cols) if c.startswith((f"{cols.target}_", f"{cols.promo}_lag_", "oil_"))]


def model_features(panel: DataFrame, oil=None, holidays=None, transactions=None, horizon: int = 30,
                   windows=MODEL_WINDOWS, cols: PanelColumns = PANEL) -> DataFrame:
    """Features known ``horizon`` rows ahead, missing ones filled inside the series.

    Transactions of the future are unknown and stay out of the feature columns.
    """
    wide = engineer(panel, oil, holidays, transactions, gap=horizon, series_mean=False, lags=model_lags(horizon),
                    windows=windows, cols=cols)
    return fill_features(wide, gap_columns(wide, cols), cols, backward=False)


def assemble(df: DataFrame, columns, cols: PanelColumns = PANEL, keep=()) -> DataFrame:
    """Keys, label and one vector column."""
    cast = df.select(
        *cols.grain, *keep, F.col(cols.target).cast("double").alias(LABEL),
        *[F.col(c).cast("double").alias(f"_x_{c}") for c in columns],
    )
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol=FEATURES)
    return assembler.transform(cast).select(*cols.grain, *keep, LABEL, FEATURES)


def training_matrix(features: DataFrame, columns, fractions=(0.7, 0.775, 0.85), cols: PanelColumns = PANEL) -> DataFrame:
    """Stored matrix with its slice: train, early stopping, calibration of the bands, report."""
    known = features.where(F.col(cols.target).isNotNull())
    return label_slices(durable(assemble(known, columns, cols)), fractions, SLICES, cols)


# fitting -------------------------------------------------------------------------------------


def fit(estimator: Estimator, rows: DataFrame):
    """Fit on a non-empty matrix."""
    return estimator.fit(require_rows(rows))


def fit_boosted(matrix: DataFrame, **settings):
    """Boosted trees trained on the train slice and stopped on the stop slice."""
    rows = matrix.where(F.col("slice").isin("train", "stop")).withColumn("_stop", F.col("slice") == "stop")
    return fit(boosted_trees("_stop", **settings), rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """Point predictions, never negative."""
    return bands.clip_points(model.transform(rows), PREDICTION)


def residuals(predicted: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Actual minus predicted with the keys."""
    return predicted.select(*cols.grain, (F.col(LABEL) - F.col(PREDICTION)).alias("residual"))


def score(predicted: DataFrame, metrics=("wmape", "mae")) -> dict:
    """Accuracy figures of one prediction table (one row)."""
    return evaluation.accuracy(predicted, metrics, actual=LABEL, predicted=PREDICTION).first().asDict()


def ensemble_predict(models: dict, rows: DataFrame, weights=None, cols: PanelColumns = PANEL) -> DataFrame:
    """Weighted mean of several models on the same rows.

    The models add their column to the same rows one after another, so nothing is joined.
    """
    share, scored, total = bands.ensemble_weights(models, weights), rows, F.lit(0.0)
    for name, model in models.items():
        scored = model.transform(scored).withColumn(
            f"_p_{name}", F.greatest(F.col(PREDICTION), F.lit(0.0))
        ).drop(PREDICTION)
        total = total + F.lit(share[name]) * F.col(f"_p_{name}")
    return scored.withColumn(PREDICTION, F.greatest(total, F.lit(0.0))).drop(*[f"_p_{n}" for n in models])


# histogram boosting --------------------------------------------------------------------------

# Quantiles of the bands and variance power of the Tweedie loss.
BAND_QUANTILES = (0.1, 0.5, 0.9)
TWEEDIE_POWER = 1.5
LEARNER_ROUNDS = 100
LEAVES = 31


def learners(**settings) -> list[boosting.Booster]:
    """Point models, grown by level and best-first on sampled rows, and one model per band quantile."""
    common = {"train": (0,), "stop": (1,), "rounds": LEARNER_ROUNDS, "step": 0.15, "depth": 6, "power": TWEEDIE_POWER, "patience": 8, **settings}
    return [
        boosting.Booster("by_level", **common),
        boosting.Booster("by_leaf", **common | {"depth": common["depth"] + 1, "leaves": LEAVES, "top_rows": 0.2, "rows": 0.4}),
        *[boosting.Booster(n, "pinball", quantile=q, **common | {"depth": 4}) for n, q in zip(learned_bands(), BAND_QUANTILES)],
    ]


def learned_bands() -> list[str]:
    """Names of the quantile models."""
    return [f"p{round(q * 100)}" for q in BAND_QUANTILES]


def _with_block(matrix: DataFrame, block) -> DataFrame:
    return matrix.withColumn("_block", block).withColumn("_x", vector_to_array(FEATURES))


def fit_learners(matrix: DataFrame, boosters=None, cols: PanelColumns = PANEL) -> boosting.Model:
    """Tweedie trees of both kinds and quantile trees, trained side by side on the train slice and stopped on the stop slice."""
    number = F.array_position(F.array(*map(F.lit, SLICES)), F.col("slice")).cast("int") - 1
    return boosting.fit(require_rows(_with_block(matrix, number)), boosters or learners(), "_x", LABEL, "_block", list(cols.grain))


def apply_learners(model: boosting.Model, rows: DataFrame, weights=None) -> DataFrame:
    """``rows`` with a column per point model and their weighted mean as prediction, and ordered bands; nothing is negative."""
    low, middle, high = learned_bands()
    scored = rows.withColumn("_m", model.predict(vector_to_array(FEATURES)))
    points = [b.name for b in model.boosters if b.loss != "pinball"]
    found = [F.greatest(F.col(f"_m.{n}"), F.lit(0.0)).alias(n) for n in points]
    band = F.array_sort(F.array(*[F.greatest(F.col(f"_m.{n}"), F.lit(0.0)) for n in (low, middle, high)]))
    scored = scored.select(*[F.col(c) for c in rows.columns], *found, band.alias("_band"))
    share = bands.ensemble_weights(points, weights)
    mean = sum((F.col(n) * F.lit(share[n]) for n in points), F.lit(0.0))
    ordered = [F.get("_band", k).alias(n) for k, n in enumerate((low, middle, high))]
    return scored.select("*", mean.alias(PREDICTION), *ordered).drop("_band")


@dataclass(frozen=True)
class Learner:
    """One point model of :func:`fit_learners` with the ``transform`` of a Spark model."""

    model: boosting.Model
    name: str

    def transform(self, rows: DataFrame) -> DataFrame:
        found = self.model.only(self.name).predict(vector_to_array(FEATURES))
        return rows.withColumn(PREDICTION, found[self.name])


def save_learners(model: boosting.Model, path: str, spark: SparkSession, columns, metrics: dict | None = None) -> str:
    """Persist the models of one pass with their feature list and metrics."""
    row = (model.to_json(), list(columns), json.dumps(metrics or {}))
    info = spark.createDataFrame([row], "model string, features array<string>, metrics string")
    info.coalesce(1).write.mode("overwrite").json(path)
    return path


def load_learners(path: str, spark: SparkSession) -> boosting.Model:
    """Models saved by :func:`save_learners`."""
    return boosting.Model.from_json(spark.read.schema("model string").json(path).first()["model"])


def boosted_backtest(matrix: DataFrame, n_splits: int = 5, horizon: int = 30, min_train_frac: float = 0.5, cols: PanelColumns = PANEL,
                     **settings) -> DataFrame:
    """Rolling backtest of the Tweedie trees; one pass over the matrix a tree level trains all folds.

    Dates are cut into blocks at every cutoff, test end and start of a fold's stopping rows, and a
    fold's model learns from the blocks up to its own.
    """
    folds = rolling_folds(matrix, n_splits, horizon, min_train_frac, cols)
    spark, day = matrix.sparkSession, F.col(cols.date)
    if not folds:
        return spark.createDataFrame([], BACKTEST_SCHEMA)
    stops = [split_dates(f.train(matrix, cols.date), [1 - STOP_SHARE], cols)[0] for f in folds]
    ends = sorted({d for f, s in zip(folds, stops) for d in (s, f.cutoff, f.test_end)})
    block = sum(((day > F.lit(d)).cast("int") for d in ends), F.lit(0))
    until = lambda d: tuple(range(ends.index(d) + 1))
    base = learners(**settings)[0]
    boosters = [
        replace(base, name=f"fold_{f.number}", train=until(s), stop=tuple(n for n in until(f.cutoff) if n not in until(s)))
        for f, s in zip(folds, stops)
    ]
    model = boosting.fit(_with_block(matrix, block), boosters, "_x", LABEL, "_block", list(cols.grain))
    scored = matrix.withColumn("_m", model.predict(vector_to_array(FEATURES)))
    plan = F.array(*[
        F.struct(
            F.lit(f.number).alias("fold"), F.lit(f.cutoff).alias("cutoff"), F.lit(f.test_end).alias("end"),
            F.greatest(F.col(f"_m.fold_{f.number}"), F.lit(0.0)).alias("prediction"),
        )
        for f in folds
    ])
    tested = scored.select(LABEL, day, F.explode(F.filter(plan, lambda f: (day > f["cutoff"]) & (day <= f["end"]))).alias("_f"))
    figures = fold_figures(
        tested.select("_f.fold", "_f.cutoff", LABEL, F.col("_f.prediction").alias("_p")), F.col(LABEL), F.col("_p"), ["fold", "cutoff"]
    )
    counts = matrix.agg(*[F.count_if(day <= F.lit(f.cutoff)).alias(f"n{f.number}") for f in folds]).first()
    sizes = spark.createDataFrame([(f.number, counts[f"n{f.number}"]) for f in folds], "number int, n_train long")
    return figures.join(sizes, figures["fold"] == sizes["number"]).select("fold", "cutoff", "n_train", "n_test", "wmape", "mae")


# search and validation -----------------------------------------------------------------------


def sample_settings(trials: int, seed: int = 42, ranges=None) -> list[dict]:
    """Seeded random settings inside the search ranges."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        out.append(
            {
                name: _draw(rng, name, low, high) for name, (low, high) in (ranges or SEARCH_RANGES).items()
            }
        )
    return out


def _draw(rng: random.Random, name: str, low, high):
    if isinstance(low, int):
        return rng.randint(low, high)
    value = math.exp(rng.uniform(math.log(low), math.log(high))) if name == "stepSize" else rng.uniform(low, high)
    return str(round(value, 4)) if name == "featureSubsetStrategy" else round(value, 4)


def early_stopped(**settings) -> Estimator:
    """Boosted trees that end on the last dates of whatever rows they are fitted on."""
    return boosted_trees("_stop", **settings)


def stop_date(rows: DataFrame, cols: PanelColumns = PANEL) -> date:
    """The last date before the STOP_SHARE of the rows that fits stop on; a value, as a subquery would run again in every job of a fit."""
    return split_dates(rows, [1 - STOP_SHARE], cols)[0]


def fit_fold(estimator: Estimator, rows: DataFrame, cols: PanelColumns = PANEL, cut: date | None = None):
    """Fit; an estimator that stops early gets the last STOP_SHARE of the rows, by date, to stop on: those after ``cut`` if it is known."""
    if estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol"):
        cut = stop_date(rows, cols) if cut is None else cut
        rows = rows.withColumn(estimator.getValidationIndicatorCol(), F.col(cols.date) > F.lit(cut))
    return fit(estimator, rows)


def _fold_score(estimator: Estimator, matrix: DataFrame, fold: Fold, metrics, cols, cut: date | None = None) -> dict:
    model = fit_fold(estimator, fold.train(matrix, cols.date), cols, cut)
    return score(predict(model, fold.test(matrix, cols.date)), metrics)


def in_parallel(work: Callable, items, at_once: int = PARALLEL_FITS) -> list:
    """Results in order; the jobs of several fits share the cluster."""
    items = list(items)
    if not items:
        return []
    with ThreadPool(min(at_once, len(items))) as pool:
        return pool.map(work, items)


@contextmanager
def kept(matrix: DataFrame) -> Iterator[DataFrame]:
    """The same rows in the same partitions, decoded once and kept on the executors, spilling to their disks, while many fits read them."""
    rows = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def tune(matrix: DataFrame, factory: Callable[..., Estimator] = early_stopped, trials: int = TRIALS, folds: int = 3,
         seed: int = 42, ranges=None, cols: PanelColumns = PANEL) -> DataFrame:
    """Trial table: settings, mean WMAPE over expanding folds, and whether it is the best."""
    cuts, settings = expanding_folds(matrix, folds, cols), sample_settings(trials, seed, ranges)
    stops = {f.number: stop_date(f.train(matrix, cols.date), cols) for f in cuts}
    jobs = [(s, f) for s in settings for f in cuts]
    with kept(matrix) if jobs else nullcontext(matrix) as kept_rows:
        scores = in_parallel(lambda j: _fold_score(factory(**j[0]), kept_rows, j[1], ("wmape",), cols, stops[j[1].number])["wmape"], jobs)
    rows = [
        (i + 1, json.dumps(s), float(sum(scores[i * len(cuts) : (i + 1) * len(cuts)]) / len(cuts)))
        for i, s in enumerate(settings)
    ]
    spark = matrix.sparkSession
    table = spark.createDataFrame(rows, "trial int, settings string, wmape double")
    best = F.min_by("trial", F.struct("wmape", "trial")).over(Window.partitionBy())  # one row per trial
    return table.withColumn("is_best", F.col("trial") == best)


def cross_validate(matrix: DataFrame, factory: Callable[[], Estimator], folds: int = 5, metric: str = "wmape",
                   cols: PanelColumns = PANEL) -> DataFrame:
    """Expanding-window scores with their mean and sample std."""
    cuts = expanding_folds(matrix, folds, cols)
    scores = in_parallel(lambda f: _fold_score(factory(), matrix, f, (metric,), cols)[metric], cuts)
    rows = [(f.number, f.cutoff, float(s)) for f, s in zip(cuts, scores)]
    table = matrix.sparkSession.createDataFrame(rows, "fold int, cutoff date, score double")
    every = Window.partitionBy()  # one row per fold
    return table.withColumns({"mean": F.avg("score").over(every), "std": F.stddev_samp("score").over(every)})


BACKTEST_SCHEMA = "fold int, cutoff date, n_train bigint, n_test bigint, wmape double, mae double"


def rolling_backtest(matrix: DataFrame, factory: Callable[[], Estimator], n_splits: int = 5, horizon: int = 30,
                     min_train_frac: float = 0.5, cols: PanelColumns = PANEL) -> DataFrame:
    """Refit at several cutoffs, score the next dates. ``factory`` returns a fresh Estimator."""
    folds = rolling_folds(matrix, n_splits, horizon, min_train_frac, cols)
    if not folds:
        return matrix.sparkSession.createDataFrame([], BACKTEST_SCHEMA)
    counts = matrix.agg(*[F.count_if(F.col(cols.date) <= F.lit(f.cutoff)) for f in folds]).first()

    def run(fold: Fold) -> tuple:
        model = fit_fold(factory(), fold.train(matrix, cols.date), cols)
        figures = fold_figures(predict(model, fold.test(matrix, cols.date)), F.col(LABEL), F.col(PREDICTION)).first()
        return fold.number, fold.cutoff, counts[fold.number - 1], figures["n_test"], figures["wmape"], figures["mae"]

    return matrix.sparkSession.createDataFrame(in_parallel(run, folds), BACKTEST_SCHEMA)


def fold_figures(df: DataFrame, actual, predicted, by=()) -> DataFrame:
    """Rows, WMAPE and MAE, rounded to three places, overall or per fold."""
    error = F.abs(actual - predicted)
    aggregates = [
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.sum(error) / F.greatest(F.sum(F.abs(actual)), F.lit(1e-9)) * 100, 3).alias("wmape"),
        F.round(F.avg(error), 3).alias("mae"),
    ]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def mean_backtest(panel: DataFrame, n_splits: int = 5, horizon: int = 30, min_train_frac: float = 0.5,
                  cols: PanelColumns = PANEL) -> DataFrame:
    """Backtest of the series mean: all folds in one query, because a mean needs no fitting loop."""
    folds = rolling_folds(panel, n_splits, horizon, min_train_frac, cols)
    spark = panel.sparkSession
    if not folds:
        return spark.createDataFrame([], BACKTEST_SCHEMA)
    y, day = F.col(cols.target), F.col(cols.date)
    learnt = panel.groupBy(*cols.series).agg(
        F.array(*[F.avg(F.when(day <= F.lit(f.cutoff), y)) for f in folds]).alias("_means"),
        F.array(*[F.count_if(day <= F.lit(f.cutoff)) for f in folds]).alias("_sizes"),
    )
    learnt = durable(learnt)  # one row per series
    sizes = learnt.select(F.posexplode("_sizes").alias("_i", "_n")).groupBy("_i").agg(F.sum("_n").alias("n_train"))
    plan = F.array(
        *[
            F.struct(F.lit(f.number).alias("fold"), F.lit(f.cutoff).alias("cutoff"), F.lit(f.test_end).alias("end"))
            for f in folds
        ]
    )
    # a row is kept once per fold that tests it
    tested = panel.withColumn(
        "_f", F.explode(F.filter(plan, lambda f: (day > f["cutoff"]) & (day <= f["end"])))
    ).join(learnt, cols.series, "left")
    mean = F.greatest(F.coalesce(F.element_at("_means", F.col("_f.fold")), F.lit(0.0)), F.lit(0.0))
    figures = fold_figures(
        tested.select(F.col("_f.fold").alias("fold"), F.col("_f.cutoff").alias("cutoff"), y, mean.alias("_m")),
        y, F.col("_m"), ["fold", "cutoff"],
    )
    return figures.join(sizes, figures.fold == sizes._i + 1).select(
        "fold", "cutoff", "n_train", "n_test", "wmape", "mae"
    )


# importance and persistence ------------------------------------------------------------------


def importance(model, columns, spark: SparkSession) -> DataFrame:
    """Tree importance per feature: normalised, cumulative, largest first."""
    fitted = model.stages[-1] if isinstance(model, PipelineModel) else model
    weights = [float(x) for x in fitted.featureImportances.toArray()]
    total = sum(weights)
    table = spark.createDataFrame(list(zip(columns, weights)), "feature string, importance double")
    return cumulative_importance(table, total)


def cumulative_importance(table: DataFrame, total: float | None = None) -> DataFrame:
    """Normalised and running importance (one row per feature)."""
    whole = F.sum("importance").over(Window.partitionBy()) if total is None else F.lit(float(total))
    order = Window.orderBy(F.col("importance").desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    shared = table.withColumn("share", F.col("importance") / F.nullif(whole, F.lit(0.0)))
    return shared.withColumn("cumulative_share", F.sum("share").over(order))


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features."""
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def save_model(model, path: str, spark: SparkSession, name: str, columns, metrics: dict | None = None) -> str:
    """Persist a fitted model with its name, feature list and metrics beside it."""
    path = path.rstrip("/")
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(f"{path}/model")
    info = spark.createDataFrame(
        [(name, list(columns), json.dumps(metrics or {}))], "name string, features array<string>, metrics string"
    )
    info.coalesce(1).write.mode("overwrite").json(f"{path}/info")
    return path


def load_model(path: str) -> PipelineModel:
    """A saved model."""
    return PipelineModel.load(f"{path.rstrip('/')}/model")


def model_info(path: str, spark: SparkSession) -> DataFrame:
    """Name, features and metrics of a saved model."""
    return spark.read.schema("name string, features array<string>, metrics string").json(f"{path.rstrip('/')}/info")


# job -----------------------------------------------------------------------------------------


def train(panel: DataFrame, oil=None, holidays=None, transactions=None, horizon: int = 30, trees: dict | None = None,
          forest: dict | None = None, weights=None, backtest_splits: int = 0, save_to: str | None = None,
          check_grain: bool = True, cols: PanelColumns = PANEL, backtest_model: str = "boosted", learner: str = "mllib") -> dict:
    """Split, fit boosted trees and forest, learn residual quantiles, report on the last slice.

    Trees stop on one slice, bands are learnt on the next and all is reported on the last.
    ``backtest_splits`` adds a rolling backtest of the boosted trees, or of the forest with
    ``backtest_model="forest"``; ``save_to`` a folder with the models.

    ``learner="histogram"`` trains Tweedie trees grown by level and best-first and a tree model per band
    quantile in one pass (:func:`fit_learners`, whose settings ``trees`` then are) in place of the two;
    forecasts take their bands from the quantile models, and all backtest folds share one pass.
    """
    if learner not in ("mllib", "histogram"):
        raise ValueError(f"unknown learner {learner}")
    factories = {"boosted": lambda: early_stopped(**(trees or {})), "forest": lambda: random_forest(**(forest or {}))}
    if backtest_model not in factories:
        raise ValueError(f"unknown backtest model {backtest_model}")
    if check_grain:
        require_daily_grain(panel, cols)
    features = model_features(panel, oil, holidays, transactions, horizon, cols=cols)
    columns = feature_columns(features, cols)
    matrix = training_matrix(features, columns, cols=cols)
    later = matrix.where(F.col("slice") != "train")
    if learner == "histogram":
        learned = fit_learners(matrix, learners(**(trees or {})), cols)
        models = {b.name: Learner(learned, b.name) for b in learned.boosters if b.loss != "pinball"}
        held = durable(apply_learners(learned, later, weights).drop(FEATURES))
    else:
        models = {
            "boosted": fit_boosted(matrix, **(trees or {})),
            "forest": fit(random_forest(**(forest or {})), matrix.where(F.col("slice") == "train")),
        }
        held = durable(ensemble_predict(models, later, weights, cols).drop(FEATURES))
    calibration = durable(residuals(held.where(F.col("slice") == "calibrate"), cols))
    offsets = bands.pooled_offsets(calibration, cols.series)
    report = held.where(F.col("slice") == "report")
    metrics = score(report, ("mae", "rmse", "mape", "wmape", "r2"))
    extra, spark = {}, panel.sparkSession
    if learner == "histogram":
        extra["learned"] = learned
        if backtest_splits:
            extra["backtest"] = boosted_backtest(matrix, backtest_splits, horizon, cols=cols, **(trees or {}))
        if save_to:
            extra["saved"] = {"learners": save_learners(learned, f"{save_to.rstrip('/')}/learners", spark, columns, metrics)}
    else:
        if backtest_splits:
            extra["backtest"] = rolling_backtest(matrix, factories[backtest_model], backtest_splits, horizon, cols=cols)
        if save_to:
            extra["saved"] = {
                n: save_model(m, f"{save_to.rstrip('/')}/{n}", spark, n, columns, metrics) for n, m in models.items()
            }
    return extra | {
        "models": models,
        "columns": columns,
        "matrix": matrix,
        "offsets": durable(offsets),
        "holdout": report,
        "metrics": metrics,
    }
