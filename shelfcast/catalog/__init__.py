"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from shelfcast.catalog.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
