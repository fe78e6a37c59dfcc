"""The feature chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators import external, features


def engineer(panel: DataFrame, oil: DataFrame | None = None, holidays: DataFrame | None = None,
             transactions: DataFrame | None = None, gap: int = 0, series_mean: bool = True,
             lags=features.LAGS, windows=features.WINDOWS, cols: PanelColumns = PANEL,
             start: features.SeriesStart | None = None) -> DataFrame:
    """All features of a daily panel.

    Day-level tables come in with one join, transactions with another, and every series feature
    uses the same partitioning and order, so the panel is shuffled once for all of them.
    Models use a ``gap`` and lags of at least the forecast horizon and ``series_mean=False``, so
    that no feature holds a value that is unknown when the forecast is made. ``start`` says what came
    before the given rows, for panels that hold the last rows of each series only.
    """
    df = panel
    if oil is not None or holidays is not None:
        df = external.with_day_table(df, oil, holidays, cols)
    if transactions is not None:
        df = external.with_transactions(df, external.transaction_features(transactions, cols), cols)

    # two passes over the sorted series: the second needs the results of the first
    window = features.series_window(df, cols)
    rolled = features.rolling_columns(window, cols, windows, gap)
    first = {
        **features.lag_columns(window, cols, lags),
        **rolled,
        **features.promo_columns(window, cols),
        "_row": F.row_number().over(window) + (start.rows if start else 0),
    }
    if series_mean:
        first["store_family_mean_sales"] = features.series_mean(window, cols)
    second = {**features.filled_columns(window, rolled, start), **features.run_columns(window, "_row", cols, start=start)}
    df = df.withColumns(first).withColumns(second).drop("_row")
    # plain projections last: they add no shuffle and keep the sorted rows narrow
    return features.add_interactions(features.add_calendar(df, cols), cols)
