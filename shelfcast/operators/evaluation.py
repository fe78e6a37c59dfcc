"""Forecast accuracy, residual tests and model comparison.

Sequence metrics (MASE, direction, Ljung-Box) follow one of two orders: inside each series, whose
daily grain bounds the window, or along a stated order of the whole table, cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.functions.safe import correlation, finite, ratio
from shelfcast.functions.stats import chi_square_tail, correlation_p_value_column
from shelfcast.operators.ordering import with_lookback

ACTUAL, PREDICTED = "actual", "predicted"


def usable_pairs(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Rows whose actual and predicted value are both finite."""
    return df.where(finite(F.col(actual)) & finite(F.col(predicted)))


def _accuracy(actual: str, predicted: str) -> dict:
    y, p = F.col(actual), F.col(predicted)
    err, size = F.abs(y - p), (F.abs(y) + F.abs(p)) / 2
    return {
        "mae": F.avg(err),
        "rmse": F.sqrt(F.avg(err * err)),
        "mbe": F.avg(p - y),
        "mape": F.avg(ratio(err, F.abs(y))) * 100,
        "wmape": ratio(F.sum(err), F.sum(F.abs(y))) * 100,
        "smape": F.avg(ratio(err, size)) * 100,
        "r2": F.when(
            F.count(y) > 1, F.lit(1.0) - ratio(F.sum(err * err), F.var_pop(y) * F.count(y))
        ),
    }


def accuracy(df: DataFrame, metrics=None, by=(), actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Order-free accuracy figures, overall or per group, in one pass."""
    every = _accuracy(actual, predicted)
    chosen = {m: every[m] for m in (metrics or every)}
    pairs = usable_pairs(df, actual, predicted)
    aggregates = [F.count(F.lit(1)).alias("n"), *[e.alias(m) for m, e in chosen.items()]]
    return pairs.groupBy(*by).agg(*aggregates) if by else pairs.agg(*aggregates)


def model_metrics(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """The reduced set kept with a model."""
    return accuracy(df, ("mae", "rmse", "mape", "wmape", "r2"), actual=actual, predicted=predicted)


def _with_previous(df: DataFrame, columns, depth: int, order, cols: PanelColumns) -> DataFrame:
    """Add ``<column>_prev_<k>`` along the series, or along ``order`` over the whole table."""

    def build(window):
        return [F.lag(c, k).over(window).alias(f"{c}_prev_{k}") for c in columns for k in range(1, depth + 1)]

    if order is None:
        window = Window.partitionBy(*cols.series).orderBy(cols.date)
        return df.select("*", *build(window))
    return with_lookback(df, [F.col(c) for c in order], depth, build)


def sequence_metrics(df: DataFrame, order=None, cols: PanelColumns = PANEL,
                     actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """MASE and directional accuracy.

    ``order=None`` takes steps inside each series; a list of columns takes them along that order.
    """
    stepped = _with_previous(usable_pairs(df, actual, predicted), [actual, predicted], 1, order, cols)
    y, p = F.col(actual), F.col(predicted)
    y_step, p_step = y - F.col(f"{actual}_prev_1"), p - F.col(f"{predicted}_prev_1")
    same = F.when(y_step.isNotNull(), ((y_step > 0) == (p_step > 0)).cast("int"))
    return stepped.agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.avg(F.abs(y - p)), F.avg(F.abs(y_step))).alias("mase"),
        (F.avg(same) * 100).alias("directional_accuracy"),
    )


def residual_profile(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Mean, population std, population skewness and excess kurtosis of the residuals."""
    e = F.col(predicted) - F.col(actual)
    return usable_pairs(df, actual, predicted).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("mean_residual"),
        F.stddev_pop(e).alias("std_residual"),
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
    )


def ljung_box(df: DataFrame, order=None, lags: int = 10, cols: PanelColumns = PANEL,
              actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Ljung-Box statistic and p-value of the residuals; null for ``lags`` rows or fewer."""
    residuals = usable_pairs(df, actual, predicted).withColumn("_e", F.col(predicted) - F.col(actual))
    mean = residuals.agg(F.avg("_e")).scalar()
    centred = residuals.withColumn("_e", F.col("_e") - mean)
    lagged = _with_previous(centred, ["_e"], lags, order, cols)
    sums = lagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_v"),
        *[F.sum(F.col("_e") * F.col(f"_e_prev_{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    n = F.col("n").cast("double")
    terms = [F.pow(ratio(F.col(f"_c{k}"), F.col("_v")), 2) / F.nullif(n - k, F.lit(0.0)) for k in range(1, lags + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    statistic = F.when(n > lags, n * (n + 2) * total)
    return sums.select("n", statistic.alias("statistic")).withColumn(
        "p_value", chi_square_tail(F.col("statistic"), lags)
    )


def jarque_bera(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Jarque-Bera normality test of the residuals."""
    profile = residual_profile(df, actual, predicted)
    s, k = F.col("skewness"), F.col("kurtosis")
    return profile.select("n", (F.col("n") / 6 * (s * s + k * k / 4)).alias("statistic")).withColumn(
        "p_value", F.exp(-F.col("statistic") / 2)
    )


def heteroscedasticity(df: DataFrame, with_p_value: bool = True, actual: str = ACTUAL,
                       predicted: str = PREDICTED) -> DataFrame:
    """Correlation of the prediction with the squared residual."""
    e = F.col(predicted) - F.col(actual)
    one = usable_pairs(df, actual, predicted).agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col(predicted), e * e).alias("correlation")
    )
    return one.withColumn("p_value", correlation_p_value_column(F.col("correlation"), F.col("n"))) if with_p_value else one


def compare_models(metrics: DataFrame, by: str = "wmape") -> DataFrame:
    """Rank of each model by one metric, ties share the mean rank. One row per model."""
    position = F.rank().over(Window.orderBy(F.col(by).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by))
    return metrics.withColumn(f"{by}_rank", F.when(F.col(by).isNotNull(), position + (ties - 1) / 2))


# Texts of the report's advice and the limits they depend on.
EXCELLENT = "Excellent forecast accuracy - model is production ready"
GOOD = "Good forecast accuracy - minor improvements possible"
POOR = "Poor forecast accuracy - model needs significant improvement"
LOW_FIT = "Low R² indicates poor model fit - consider feature engineering"
AUTOCORRELATED = "Autocorrelation detected in residuals - consider time series modeling"
NOT_NORMAL = "Non-normal residuals detected - check for outliers or model specification"
EXCELLENT_WMAPE, GOOD_WMAPE, LEAST_R2, SIGNIFICANCE = 10, 20, 0.5, 0.05


def report_advice(wmape, r2, ljung_p, jarque_p):
    """Texts that follow from the metrics, as an array column."""
    accuracy_text = (
        F.when(wmape < EXCELLENT_WMAPE, EXCELLENT).when(wmape < GOOD_WMAPE, GOOD).when(wmape.isNotNull(), POOR)
    )
    others = [(r2 < LEAST_R2, LOW_FIT), (ljung_p < SIGNIFICANCE, AUTOCORRELATED), (jarque_p < SIGNIFICANCE, NOT_NORMAL)]
    return F.array_compact(F.array(accuracy_text, *[F.when(test, text) for test, text in others]))


def evaluation_report(df: DataFrame, model: str, order=None, cols: PanelColumns = PANEL,
                      actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """All figures, tests and advice of one model in one row."""
    names = dict(actual=actual, predicted=predicted)
    figures = accuracy(df, **names)
    sequence = sequence_metrics(df, order, cols, **names).drop("n")
    profile = residual_profile(df, **names).drop("n")
    box = ljung_box(df, order, cols=cols, **names).select(
        F.col("statistic").alias("ljung_box"), F.col("p_value").alias("ljung_box_p")
    )
    bera = jarque_bera(df, **names).select(
        F.col("statistic").alias("jarque_bera"), F.col("p_value").alias("jarque_bera_p")
    )
    spread = heteroscedasticity(df, **names).select(
        F.col("correlation").alias("heteroscedasticity"), F.col("p_value").alias("heteroscedasticity_p")
    )
    one = F.lit(1).alias("_one")
    whole = figures.select(F.lit(model).alias("model"), "*", one)
    for part in (sequence, profile, box, bera, spread):  # every part is a single row
        whole = whole.join(part.select("*", one), "_one")
    advice = report_advice(F.col("wmape"), F.col("r2"), F.col("ljung_box_p"), F.col("jarque_bera_p"))
    return whole.drop("_one").withColumn("recommendations", advice)


def report_json(report: DataFrame) -> DataFrame:
    """The report row as one JSON text per model."""
    return report.select("model", F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("report"))
