"""Chronological splits and folds. Only a handful of dates reach the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns


def _split_row(df: DataFrame, fractions, cols: PanelColumns) -> DataFrame:
    """One row with the date at each ``int(fraction * rows)`` in date order."""
    per_day = df.groupBy(cols.date).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(cols.date)  # one row per calendar day
    counted = per_day.select(
        cols.date,
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    return counted.agg(
        *[
            F.min(F.when(F.col("_upto") > F.floor(F.lit(f) * F.col("_all")), F.col(cols.date))).alias(f"_d{i}")
            for i, f in enumerate(fractions)
        ]
    )


def split_dates(df: DataFrame, fractions, cols: PanelColumns = PANEL) -> list[date]:
    """The cut dates, one per fraction."""
    return list(_split_row(df, fractions, cols).first())


def split_date(df: DataFrame, fraction: float = 0.8, cols: PanelColumns = PANEL) -> Column:
    """One cut date as a scalar subquery, without a job of its own."""
    return _split_row(df, [fraction], cols).scalar()


def label_slices(df: DataFrame, fractions=(0.8,), names=("train", "holdout"), cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``slice`` by chronological cut dates; rows up to the cut belong to the earlier slice."""
    label = F.lit(names[-1])
    for cut, name in reversed(list(zip(split_dates(df, fractions, cols), names))):
        label = F.when(F.col(cols.date) <= F.lit(cut), name).otherwise(label)
    return df.withColumn("slice", label)


def chronological_split(df: DataFrame, fraction: float = 0.8, cols: PanelColumns = PANEL):
    """Rows up to the cut date, and the rows after it."""
    cut = split_date(df, fraction, cols)
    return df.where(F.col(cols.date) <= cut), df.where(F.col(cols.date) > cut)


@dataclass(frozen=True)
class Fold:
    """Train on dates up to ``cutoff``, test on later dates up to ``test_end``."""

    number: int
    cutoff: date
    test_end: date

    def train(self, df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(name) <= F.lit(self.cutoff))

    def test(self, df: DataFrame, name: str) -> DataFrame:
        return df.where((F.col(name) > F.lit(self.cutoff)) & (F.col(name) <= F.lit(self.test_end)))


def _dates_at(df: DataFrame, positions, name: str) -> dict[int, date]:
    days = df.select(name).where(F.col(name).isNotNull()).distinct()
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy(name)) - 1)  # calendar days
    wanted = numbered.where(F.col("_i").isin(sorted(set(positions))))
    return {r["_i"]: r[name] for r in wanted.collect()}  # two dates per fold


def _day_count(df: DataFrame, name: str) -> int:
    return df.select(name).where(F.col(name).isNotNull()).distinct().count()


def rolling_folds(df: DataFrame, n_splits: int = 5, horizon: int = 30, min_train_frac: float = 0.5,
                  cols: PanelColumns = PANEL) -> list[Fold]:
    """Cutoffs evenly spaced over the distinct dates, each tested on the next ``horizon`` dates."""
    days = _day_count(df, cols.date)
    if days < n_splits + horizon + 1:
        return []
    first, last = int(days * min_train_frac), days - horizon - 1
    step = (last - first) / (n_splits - 1) if n_splits > 1 else 0.0
    spaced = {int(first + i * step) if i < n_splits - 1 or n_splits == 1 else last for i in range(n_splits)}
    cuts = sorted(c for c in spaced if 0 < c < days - 1)
    ends = {c: min(c + horizon, days - 1) for c in cuts}
    at = _dates_at(df, [*cuts, *ends.values()], cols.date)
    return [Fold(i, at[c], at[ends[c]]) for i, c in enumerate(cuts, 1)]


def expanding_folds(df: DataFrame, n_folds: int = 3, cols: PanelColumns = PANEL) -> list[Fold]:
    """Equal blocks of dates; each block is tested on everything before it."""
    days = _day_count(df, cols.date)
    block = days // (n_folds + 1)
    if block < 1:
        return []
    cuts = [days - block * (n_folds - i) - 1 for i in range(n_folds)]
    at = _dates_at(df, [*cuts, *[c + block for c in cuts]], cols.date)
    return [Fold(i, at[c], at[c + block]) for i, c in enumerate(cuts, 1)]
