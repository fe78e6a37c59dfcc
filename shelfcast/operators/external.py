"""Macro index, holiday and transaction features and their joins to the panel.

The index and the holidays are one row per day, so their windows hold at most one row per calendar
day. Joins to the panel go through :func:`shelfcast.plans.durable.durable`: the planner then knows
the size of the joined table and broadcasts it only when it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.functions.safe import nan_to_null, ratio
from shelfcast.plans.durable import durable

FAR_AWAY_DAYS = 365


def _full(fn, column, window, rows):
    """Aggregate over exactly ``rows`` rows; null while the window is not full."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) == rows, fn(column).over(frame))


def index_features(index: DataFrame, date: str = "date", price: str = "dcoilwtico") -> DataFrame:
    """Lags, change, means and volatility of a daily index, gaps filled forward, then backward."""
    day = Window.orderBy(date)
    back = day.rowsBetween(Window.unboundedPreceding, 0)
    whole = day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def filled(c):
        # only leading gaps are left after the forward fill; they take the first known value
        return F.coalesce(F.last(c, True).over(back), F.first(c, True).over(whole))

    base = nan_to_null(index.select(date, price)).select(date, filled(price).alias(price))
    x = F.col(price)
    derived = base.select(
        date,
        price,
        F.lag(x, 1).over(day).alias("oil_price_lag_1"),
        F.lag(x, 7).over(day).alias("oil_price_lag_7"),
        (x - F.lag(x, 1).over(day)).alias("oil_price_change"),
        (ratio(x, F.lag(x, 1).over(day)) - 1).alias("oil_price_change_pct"),
        _full(F.avg, price, day, 7).alias("oil_price_ma_7"),
        _full(F.avg, price, day, 30).alias("oil_price_ma_30"),
        _full(F.stddev_samp, price, day, 7).alias("oil_volatility_7"),
    )
    return derived.select(date, *[filled(c).alias(c) for c in derived.columns if c != date])


def holidays_by_date(holidays: DataFrame, date: str = "date") -> DataFrame:
    """One row per holiday date: types and locales joined by ';', any transfer."""
    return holidays.groupBy(date).agg(
        F.array_join(F.array_sort(F.collect_set("type")), ";").alias("holiday_type"),
        F.array_join(F.array_sort(F.collect_set("locale")), ";").alias("holiday_locale"),
        F.bool_or("transferred").cast("int").alias("is_transferred"),
        F.lit(1).alias("is_holiday"),
    )


def holiday_distances(holidays: DataFrame, date: str = "date", reach: int = FAR_AWAY_DAYS) -> DataFrame:
    """Days to the next and since the last holiday for each calendar day near one.

    The calendar comes from the holidays alone (the days within ``reach`` of one), so the panel is
    not scanned for its dates; days not listed are ``reach`` away on both sides. The day itself
    does not count.
    """
    days = holidays.select(F.col(date).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    span = days.agg(F.date_sub(F.min("_h"), reach).alias("_a"), F.date_add(F.max("_h"), reach).alias("_b"))
    spine = span.where(F.col("_a").isNotNull()).select(
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date)
    )
    marked = spine.join(days, spine[date] == days["_h"], "left").select(date, "_h")
    earlier = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.last("_h", True).over(earlier), F.last("_h", True).over(later)
    far = F.lit(reach)
    return marked.select(
        date,
        F.least(far, F.coalesce(F.datediff(after, F.col(date)), far)).alias("days_to_holiday"),
        F.least(far, F.coalesce(F.datediff(F.col(date), before), far)).alias("days_from_holiday"),
    )


def transaction_features(transactions: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Lags, means and growth per store; gaps filled forward inside the store, then 0."""
    t = "transactions"
    w = Window.partitionBy(cols.store).orderBy(cols.date)
    base = nan_to_null(transactions.select(cols.date, cols.store, F.col(t).cast("double").alias(t)))
    derived = base.select(
        cols.date,
        cols.store,
        t,
        F.lag(t, 1).over(w).alias(f"{t}_lag_1"),
        F.lag(t, 7).over(w).alias(f"{t}_lag_7"),
        _full(F.avg, t, w, 7).alias(f"{t}_ma_7"),
        _full(F.avg, t, w, 30).alias(f"{t}_ma_30"),
        (ratio(F.col(t), F.lag(t, 1).over(w)) - 1).alias(f"{t}_growth"),
    )
    return derived.select(
        cols.date,
        cols.store,
        *[
            F.coalesce(F.last(c, True).over(w), F.lit(0.0)).alias(c)
            for c in derived.columns
            if c not in (cols.date, cols.store)
        ],
    )


def with_index(panel: DataFrame, features: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Left join of daily index features."""
    return panel.join(durable(features), cols.date, "left")


def _holiday_defaults():
    return {
        "is_holiday": F.coalesce("is_holiday", F.lit(0)),
        "is_transferred": F.coalesce("is_transferred", F.lit(0)),
        "holiday_type": F.coalesce("holiday_type", F.lit("None")),
        "holiday_locale": F.coalesce("holiday_locale", F.lit("None")),
    }


def with_holidays(panel: DataFrame, by_date: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Left join of holidays; other days get 0 and 'None'."""
    return panel.join(durable(by_date), cols.date, "left").withColumns(_holiday_defaults())


def _distance_defaults(reach: int = FAR_AWAY_DAYS):
    return {c: F.coalesce(c, F.lit(reach)) for c in ("days_to_holiday", "days_from_holiday")}


def with_holiday_distances(panel: DataFrame, holidays: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Left join of the distances to the neighbouring holidays."""
    return panel.join(durable(holiday_distances(holidays, cols.date)), cols.date, "left").withColumns(
        _distance_defaults()
    )


def with_transactions(panel: DataFrame, features: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Left join of transaction features on (date, store)."""
    return panel.join(durable(features), [cols.date, cols.store], "left")


def day_table(index: DataFrame | None, holidays: DataFrame | None, date: str = "date") -> DataFrame:
    """All day-level features in one table, so the panel is joined by date only once."""
    parts = []
    if index is not None:
        parts.append(index_features(index, date))
    if holidays is not None:
        parts += [holidays_by_date(holidays, date), holiday_distances(holidays, date)]
    if not parts:
        raise ValueError("day_table needs an index or holidays")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(p, date, "full")
    return whole


def with_day_table(panel: DataFrame, index: DataFrame | None = None, holidays: DataFrame | None = None,
                   cols: PanelColumns = PANEL) -> DataFrame:
    """Index, holiday and distance features through a single join."""
    joined = panel.join(durable(day_table(index, holidays, cols.date)), cols.date, "left")
    return joined.withColumns({**_holiday_defaults(), **_distance_defaults()}) if holidays is not None else joined
