"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column of ``taken`` is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name for ``col``, dots and back-quotes included."""
    return "`" + name.replace("`", "``") + "`"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
