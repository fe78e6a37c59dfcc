"""Retail demand and inventory analytics as Spark DataFrame operators."""

from shelfcast.columns import PanelColumns

__all__ = ["PanelColumns"]
