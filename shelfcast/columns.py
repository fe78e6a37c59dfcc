"""Names of the panel columns; every operator takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelColumns:
    """A panel holds one row per (date, store, family) with a target and a promotion count."""

    date: str = "date"
    store: str = "store_nbr"
    family: str = "family"
    target: str = "sales"
    promo: str = "onpromotion"

    @property
    def series(self) -> list[str]:
        return [self.store, self.family]

    @property
    def grain(self) -> list[str]:
        return [self.date, self.store, self.family]

    def series_in(self, columns) -> list[str]:
        """The series keys, or none of them when either is absent."""
        return self.series if set(self.series) <= set(columns) else []


PANEL = PanelColumns()
