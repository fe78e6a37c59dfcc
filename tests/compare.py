"""Side-by-side check of a registered query and its SQL."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(_value(x) for x in v.values())
    return v


def _key(row):
    return tuple((x is not None, str(type(x)), str(x)) for x in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    names = sorted(df.columns)
    spark_rows = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=_key)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    place = [columns.index(n) for n in names]
    sql_rows = sorted((tuple(_value(r[i]) for i in place) for r in cursor.fetchall()), key=_key)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = [(n, kinds[n], types[n]) for n in names if SAME[kinds[n]] != types[n]]
    if odd:
        return f"types {odd}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return f"{dict(zip(names, a))}\n against {dict(zip(names, b))}"
    return None


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
