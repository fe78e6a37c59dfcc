"""Stock decisions from forecasts and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.operators import classify, inventory


def stock_decisions(items: DataFrame, unit_value: float = 10.0, **options) -> DataFrame:
    """Optimised, valued, classified and ranked items; one row per item."""
    valued = inventory.annual_value(inventory.optimise_stock(items, **options), unit_value=unit_value)
    return inventory.recommend(classify.abc_classes(valued))


def stock_stage(forecasts: DataFrame, stock: DataFrame, keys=("store_nbr", "family"), **options) -> DataFrame:
    """One forecast per item, joined to its stock by key, then the decisions."""
    per_item = inventory.forecast_per_item(forecasts, list(keys))
    return stock_decisions(inventory.forecast_with_stock(per_item, stock, list(keys)), **options)
