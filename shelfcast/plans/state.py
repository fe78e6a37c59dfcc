"""Model features from a kept state of the series in place of their whole history.

The state has one row per series. Its tail holds the last rows of the series: ``late`` rows after the
anchor, and before them as many as the features of the next row look back to. What all rows up to
the anchor come to is kept beside it: their number, the numbers of the last row with and without
a promotion, and the last known value of every feature that is filled forward. A new or corrected
day after the anchor is merged into the tail, so its effect on later rows is worked out anew; a day
at or before the anchor raises, since that needs the history. The size of a state does not depend
on the length of the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators.features import PROMO_LAGS, PROMO_WINDOWS, SeriesStart, series_window
from shelfcast.plans.durable import durable
from shelfcast.plans.features import engineer
from shelfcast.plans.training import MODEL_WINDOWS, gap_columns, model_lags

LATE_ROWS = 30


def reach(horizon: int, windows=MODEL_WINDOWS) -> int:
    """Rows before a row that its features look back to."""
    return max(*model_lags(horizon), max(windows) + horizon - 1, *PROMO_LAGS, *[n - 1 for n in PROMO_WINDOWS])


def _check(state: DataFrame, new: DataFrame, horizon: int, windows, cols: PanelColumns) -> None:
    """Raise on a state that was made for other features, and on days that its tails do not reach."""
    made = state.select("reach").first()
    if made is not None and made["reach"] != reach(horizon, windows):
        raise ValueError(f"the state reaches {made['reach']} rows back, the features {reach(horizon, windows)}")
    old = new.join(state.select(*cols.series, "anchor"), cols.series).where(F.col(cols.date) <= F.col("anchor")).first()
    if old is not None:
        raise ValueError(f"{old[cols.date]} of {[old[c] for c in cols.series]} is not after the state's anchor {old['anchor']}; rebuild the state")


def _merged(state: DataFrame | None, new: DataFrame, cols: PanelColumns) -> DataFrame:
    """Kept and new rows of every series with its start; a new row takes the place of the kept one of its day."""
    new = new.withColumn("_new", F.lit(True))
    if state is None:
        none = F.lit(None).cast("long")
        return new.select("*", F.lit(True).alias("_whole"), F.struct(*[none.alias(n) for n in ("before", "promo_row", "plain_row")]).alias("_start"))
    tail = state.select(*cols.series, F.inline("tail")).withColumn("_new", F.lit(False))
    both = tail.unionByName(new, allowMissingColumns=True)
    by_day = Window.partitionBy(*cols.series).orderBy(cols.date, "_new")
    both = both.withColumn("_next", F.lead(cols.date).over(by_day))
    both = both.where(~F.col(cols.date).eqNullSafe(F.col("_next"))).drop("_next")
    starts = state.select(*cols.series, "anchor", "rows", "promo_row", "plain_row")
    rows = both.join(starts, cols.series, "left").withColumn("_whole", F.col("anchor").isNull() | (F.col(cols.date) > F.col("anchor")))
    every = series_window(rows, cols).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.col("rows") - F.count_if(~F.col("_whole")).over(every)
    start = F.struct(before.alias("before"), "promo_row", "plain_row")
    return rows.withColumn("_start", start).drop("anchor", "rows", "promo_row", "plain_row")


def _described(state: DataFrame | None, new: DataFrame, oil, holidays, horizon: int, windows, cols: PanelColumns) -> tuple[DataFrame, list[str]]:
    """Rows after the anchor with their features and ``_row``, kept rows before it with null features; and the filled features."""
    part = lambda n: F.coalesce(F.col(f"_start.{n}"), F.lit(0))
    start = SeriesStart(part("before"), part("promo_row"), part("plain_row"), F.col("_whole"))
    wide = engineer(_merged(state, new, cols), oil, holidays, None, gap=horizon, series_mean=False, lags=model_lags(horizon),
                    windows=windows, cols=cols, start=start)
    names, window = gap_columns(wide, cols), series_window(wide, cols)
    fills = {c: F.last(F.when(F.col("_whole"), F.col(c)), True).over(window) for c in names}
    wide = wide.withColumns(fills | {"_row": F.row_number().over(window) + start.rows}).drop("_start")
    if state is None:
        return wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}), names
    known = wide.join(state.select(*cols.series, "known"), cols.series, "left")
    return known.withColumns({c: F.coalesce(F.col(c), F.col(f"known.{c}"), F.lit(0)) for c in names}).drop("known"), names


def features_from_state(state: DataFrame, future: DataFrame, oil=None, holidays=None, horizon: int = 30, windows=MODEL_WINDOWS,
                        cols: PanelColumns = PANEL) -> DataFrame:
    """``future`` with the features that its rows have after the whole history.

    A series without state begins with its first future row; a series without future rows has no
    row. Future rows have no target.
    """
    _check(state, future, horizon, windows, cols)
    ahead = future.withColumn(cols.target, F.lit(None).cast("double"))
    rows, _ = _described(state, ahead, oil, holidays, horizon, windows, cols)
    return rows.where("_new").drop("_new", "_whole", "_row")


def series_state(history: DataFrame, oil=None, holidays=None, horizon: int = 30, late: int = LATE_ROWS, windows=MODEL_WINDOWS,
                 cols: PanelColumns = PANEL) -> DataFrame:
    """State of every series after ``history``, which has one row per series and day."""
    return _advanced(None, history, oil, holidays, horizon, late, windows, cols)


def advance(state: DataFrame, days: DataFrame, oil=None, holidays=None, horizon: int = 30, late: int = LATE_ROWS,
            windows=MODEL_WINDOWS, cols: PanelColumns = PANEL) -> DataFrame:
    """The state after ``days`` as well: new, late or corrected rows, at most one per series and day.

    Nothing of the history is read. Series without new rows keep their state, new series get one.
    """
    _check(state, days, horizon, windows, cols)
    return _advanced(state, days, oil, holidays, horizon, late, windows, cols)


def _advanced(state, days, oil, holidays, horizon, late, windows, cols) -> DataFrame:
    keep = reach(horizon, windows)
    days = days.select(*cols.grain, F.col(cols.target).cast("double").alias(cols.target), F.col(cols.promo).cast("long").alias(cols.promo))
    rows, names = _described(state, days, oil, holidays, horizon, windows, cols)
    every = series_window(rows, cols).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A larger ``late`` than before can't move the anchor back behind what the tail holds.
    last_old = F.coalesce(F.max(F.when(~F.col("_whole"), F.col("_row"))).over(every), F.lit(0))
    at = F.greatest(F.max("_row").over(every) - F.lit(late), last_old).alias("_at")
    placed = rows.select(*cols.grain, cols.target, cols.promo, *names, "days_since_promo", "promo_streak", "_row", "_whole", at)

    def anchored(value: Column) -> Column:
        """The value of the anchor's row, if that is a row after the old anchor."""
        return F.any_value(F.when((F.col("_row") == F.col("_at")) & F.col("_whole"), value), True)

    kept = F.when(F.col("_row") > F.col("_at") - keep, F.struct(cols.date, cols.target, cols.promo))
    found = placed.groupBy(*cols.series).agg(
        F.max(F.when(F.col("_row") == F.col("_at"), F.col(cols.date))).alias("anchor"),
        F.max("_at").alias("rows"),
        anchored(F.col("_row") - F.col("days_since_promo")).alias("promo_row"),
        anchored(F.col("_row") - F.col("promo_streak")).alias("plain_row"),
        anchored(F.struct(*names)).alias("known"),
        F.sort_array(F.collect_list(kept)).alias("tail"),
    )
    if state is not None:
        last = state.select(*cols.series, F.struct("promo_row", "plain_row", "known").alias("_last"))
        carried = {c: F.coalesce(F.col(c), F.col(f"_last.{c}")) for c in ("promo_row", "plain_row", "known")}
        found = found.join(last, cols.series, "left").withColumns(carried).drop("_last")
    return durable(found.withColumn("reach", F.lit(keep)))
