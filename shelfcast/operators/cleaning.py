"""Type coercion, missing values, duplicates and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.functions.safe import nan_to_null
from shelfcast.operators.ordering import null_safe_equal
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.plans.durable import durable

OUTLIER_METHODS = ("iqr", "zscore")
REPLACEMENTS = ("p99", "clip")


def coerce_types(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Dates and numbers that do not parse become null; keys are left as they are."""
    casts = {
        cols.date: F.col(cols.date).try_cast("date"),
        cols.target: F.col(cols.target).try_cast("double"),
        cols.promo: F.col(cols.promo).try_cast("double"),
    }
    return nan_to_null(df.select(*[casts[c].alias(c) if c in casts else F.col(c) for c in df.columns]))


def fill_missing(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Drop rows without target or date, set missing promotion counts to 0."""
    required = [c for c in (cols.target, cols.date) if c in df.columns]
    filled = df.na.drop(subset=required) if required else df
    if cols.promo in df.columns:
        filled = filled.withColumn(cols.promo, F.coalesce(F.col(cols.promo), F.lit(0)))
    return filled


def missing_value_counts(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """What :func:`fill_missing` meets and does, in one pass: missing before, after, rows dropped."""
    no_target, no_date, no_promo = (F.col(c).isNull() for c in (cols.target, cols.date, cols.promo))
    return df.agg(
        F.count_if(no_target).alias("target_missing"),
        F.count_if(no_target).alias("target_dropped"),
        F.count_if(~no_target & no_promo).alias("promo_filled"),
        F.count_if(~no_target & no_date).alias("date_dropped"),
        F.count_if(~no_target & ~no_date).alias("rows_left"),
    )


def drop_duplicates(df: DataFrame, subset=None, order=()) -> DataFrame:
    """Drop rows equal in every column, or in ``subset`` only.

    Of rows equal in ``subset`` the first by the columns of ``order`` stays, ties broken by the other
    columns; nulls come first. Every task keeps its first row of each key before the shuffle.
    """
    if not subset:
        return df.dropDuplicates()
    subset = list(subset)
    ranked = [*order, *[c for c in df.columns if c not in subset and c not in order]]
    if not ranked:
        return df.dropDuplicates(subset)
    first = df.groupBy(*subset).agg(F.min(F.struct(*ranked)).alias("_first"))
    return first.select(*[F.col(c) if c in subset else F.col(f"_first.{c}") for c in df.columns])


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.sum("_n").alias("initial_count"),
            F.count(F.lit(1)).alias("final_count"),
            (F.sum("_n") - F.count(F.lit(1))).alias("removed_count"),
        )
    )


def _series_limits(df: DataFrame, cols: PanelColumns, method: str) -> DataFrame:
    """Per series: lower and upper bound and the 99th percentile, one row per series."""
    if method not in OUTLIER_METHODS:
        raise ValueError(f"unknown outlier method {method!r}, expected one of {OUTLIER_METHODS}")
    if method == "iqr":
        q = exact_quantiles(df, cols.target, {"q1": 0.25, "q3": 0.75, "p99": 0.99}, cols.series)
        spread = F.lit(1.5) * (F.col("q3") - F.col("q1"))
        return q.select(
            *cols.series, (F.col("q1") - spread).alias("_low"), (F.col("q3") + spread).alias("_high"), "p99"
        )
    p99 = exact_quantiles(df, cols.target, {"p99": 0.99}, cols.series)
    spread = F.lit(3.0) * F.nullif(F.stddev_pop(cols.target), F.lit(0.0))
    bounds = df.groupBy(*cols.series).agg(
        (F.avg(cols.target) - spread).alias("_low"), (F.avg(cols.target) + spread).alias("_high")
    )
    return bounds.join(p99, null_safe_equal(bounds, p99, cols.series)).select(
        *[bounds[c] for c in cols.series], "_low", "_high", "p99"
    )


def flag_outliers(df: DataFrame, method: str = "iqr", cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``is_outlier`` and the series' ``p99``.

    The limits are one row per series; they are stored once so that the planner sees their size and
    broadcasts them only when they are small.
    """
    limits = durable(_series_limits(df, cols, method))
    joined = df.join(limits, null_safe_equal(df, limits, cols.series), "left")
    value = F.col(cols.target)
    flag = F.coalesce((value < F.col("_low")) | (value > F.col("_high")), F.lit(False))
    return joined.select(
        *[df[c] for c in df.columns], flag.alias("is_outlier"), F.col("p99"), F.col("_low"), F.col("_high")
    )


def replace_outliers(df: DataFrame, method: str = "iqr", mode: str = "p99",
                     cols: PanelColumns = PANEL) -> DataFrame:
    """Replace flagged values: all by the series' P99, or clipped to the bounds with ``mode='clip'``."""
    if mode not in REPLACEMENTS:
        raise ValueError(f"unknown mode {mode!r}, expected one of {REPLACEMENTS}")
    flagged = flag_outliers(df, method, cols)
    value = F.col(cols.target)
    new = F.col("p99") if mode == "p99" else F.greatest(F.col("_low"), F.least(F.col("_high"), value))
    replaced = F.when(F.col("is_outlier"), new).otherwise(value)
    return flagged.select(*[replaced.alias(c) if c == cols.target else F.col(c) for c in df.columns])


def outlier_counts(flagged: DataFrame) -> DataFrame:
    """Number and percentage of flagged rows."""
    return flagged.agg(
        F.count_if("is_outlier").alias("total_outliers"),
        (F.lit(100.0) * F.count_if("is_outlier") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("outlier_percentage"),
    )


def sort_panel(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Order rows for a sink; operators never need it, their windows carry their own order."""
    return df.orderBy(*[c for c in cols.grain if c in df.columns])


def fill_features(df: DataFrame, features, cols: PanelColumns = PANEL, backward: bool = True) -> DataFrame:
    """Missing features: last value of the series, else its next value, else 0.

    A next value may hold the row's own target (lag 30 of row 31 is the target of row 1), so models
    leave the backward step out.
    """
    from shelfcast.operators.features import series_window

    w = series_window(df, cols)
    # past the forward fill only leading gaps are left, and those take the series' first known value
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        *[
            F.coalesce(F.last(c, True).over(w), *([F.first(c, True).over(whole)] if backward else []), F.lit(0)).alias(c)
            if c in features
            else F.col(c)
            for c in df.columns
        ]
    )
