"""The cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators import cleaning, profile
from shelfcast.plans.durable import durable


def clean(raw: DataFrame, outlier_method: str = "iqr", mode: str = "p99", subset=None, order=(),
          cols: PanelColumns = PANEL) -> DataFrame:
    """Types, missing values, duplicates, outliers.

    The distinct rows are stored once, because the outlier limits and the rows themselves are both
    read from them. Rows are left unsorted; sort at a sink with ``sort_panel``.
    """
    typed = cleaning.fill_missing(cleaning.coerce_types(raw, cols), cols)
    distinct = durable(cleaning.drop_duplicates(typed, subset, order))
    return cleaning.replace_outliers(distinct, outlier_method, mode, cols)


def clean_with_report(raw: DataFrame, cols: PanelColumns = PANEL, **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cleaned rows and the figures of every step as DataFrames."""
    typed = cleaning.coerce_types(raw, cols)
    filled = cleaning.fill_missing(typed, cols)
    cleaned = durable(clean(raw, cols=cols, **options))
    report = {
        "missing": cleaning.missing_value_counts(typed, cols),
        "duplicates": cleaning.duplicate_counts(filled),
        "consistency": profile.consistency_checks(cleaned, cols),
        "quality": profile.quality_report(cleaned),
    }
    return cleaned, report
