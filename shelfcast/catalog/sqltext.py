"""Pieces of SQL text shared by the registered queries."""

from __future__ import annotations


def with_(ctes, body: str) -> str:
    """WITH clause from CTE texts, then the body."""
    parts = [ctes] if isinstance(ctes, str) else list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


def r(expression: str, name: str, digits: int = 4) -> str:
    """Rounded output column."""
    return f"round({expression}, {digits}) + 0 AS {name}"


def b(expression: str, name: str) -> str:
    """Whole-number output column."""
    return f"CAST({expression} AS BIGINT) AS {name}"


KEYS = "date, CAST(store_nbr AS BIGINT) AS store_nbr, family"
SERIES = "PARTITION BY store_nbr, family"
BY_DATE = f"{SERIES} ORDER BY date"
