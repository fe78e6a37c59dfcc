"""Register of queries by operator id and name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ("tables", "cleaning", "features", "inventory", "evaluation", "reports", "forecasting")


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"shelfcast.catalog.{m}")


def all_queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
