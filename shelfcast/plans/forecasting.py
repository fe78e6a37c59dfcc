"""Forecast job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators import bands
from shelfcast.operators.features import require_daily_grain
from shelfcast.operators.profile import align_columns


def history_with_future(history: DataFrame, future: DataFrame, rows: int | None = None,
                        future_target: float | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """History stacked on the future rows, marked by ``is_future``; ``rows`` keeps the last rows of each series.

    Lags and windows count rows, so a cut counts rows of the series as well, not days. Future rows have
    no target. ``future_target=0.0`` sets it to a number instead.
    """
    past = history
    if rows is not None:
        latest = Window.partitionBy(*cols.series).orderBy(F.col(cols.date).desc())
        past = past.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= rows).drop("_back")
    ahead = future.withColumn(cols.target, F.lit(future_target).cast("double")).withColumn("is_future", F.lit(True))
    return past.withColumn("is_future", F.lit(False)).unionByName(ahead, allowMissingColumns=True)


def future_features(history: DataFrame, future: DataFrame, columns, oil=None, holidays=None, horizon: int = 30,
                    cols: PanelColumns = PANEL) -> DataFrame:
    """Keys, target and the trained feature columns of the future rows.

    Features are built on the whole history and the future together, as in training, so a row gets
    the same features in both; each reaches back at least the horizon, so none rests on a forecast.
    """
    from shelfcast.plans.training import model_features

    stacked = history_with_future(history, future, cols=cols)
    wide = model_features(stacked, oil, holidays, None, horizon, cols=cols)
    return align_columns(wide.where("is_future"), columns, [*cols.grain, cols.target])


def forecast(history: DataFrame, future: DataFrame, trained: dict, oil=None, holidays=None, horizon: int = 30,
             weights=None, name: str = "ensemble", check_grain: bool = True, cols: PanelColumns = PANEL) -> DataFrame:
    """Point and P10/P50/P90 forecasts of the future rows; ``level`` says whose residuals made the band (or "trees")."""
    if check_grain:
        require_daily_grain(history, cols)
    rows = future_features(history, future, trained["columns"], oil, holidays, horizon, cols)
    return _banded(rows, trained, weights, name, cols)


def forecast_from_state(state: DataFrame, future: DataFrame, trained: dict, oil=None, holidays=None, horizon: int = 30,
                        weights=None, name: str = "ensemble", cols: PanelColumns = PANEL) -> DataFrame:
    """The same forecasts from the kept state of the series (``plans.state``) in place of their history."""
    from shelfcast.plans.state import features_from_state

    rows = features_from_state(state, future, oil, holidays, horizon, cols=cols)
    return _banded(align_columns(rows, trained["columns"], [*cols.grain, cols.target]), trained, weights, name, cols)


def _banded(features: DataFrame, trained: dict, weights, name: str, cols: PanelColumns) -> DataFrame:
    from shelfcast.plans.training import PREDICTION, apply_learners, assemble, ensemble_predict, learned_bands

    rows = assemble(features, trained["columns"], cols)
    if trained.get("learned"):
        found = apply_learners(trained["learned"], rows, weights)
        quantiles = [F.col(c).alias(q) for c, q in zip(learned_bands(), bands.QUANTILES)]
        return found.select(
            *cols.grain, F.col(PREDICTION).alias("forecast"), *quantiles, F.lit("trees").alias("level"), F.lit(name).alias("model")
        )
    points = ensemble_predict(trained["models"], rows, weights, cols)
    banded = bands.residual_quantiles(points, trained["offsets"], cols.series)
    return banded.select(
        *cols.grain, F.col("prediction").alias("forecast"), *bands.QUANTILES, "level", F.lit(name).alias("model")
    )
