"""Exact, linearly interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordering import running_totals


def value_counts(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Rows (keys, _v, _n): how often each value occurs; nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
    return counted.agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], keys=()) -> DataFrame:
    """One row per key with the requested quantiles of ``value`` (nulls ignored).

    Rows are first reduced to a count per distinct value, then ranked along the value in ranges, so
    a key that holds most of the table is spread over many tasks.
    """
    return quantiles_of_counts(value_counts(df, value, keys), probabilities, keys)


def quantiles_of_counts(counts: DataFrame, probabilities: dict[str, float], keys=()) -> DataFrame:
    """The same from :func:`value_counts`."""
    keys = list(keys)
    ranked = running_totals(counts, [F.col("_v")], {"_upto": "_n"}, keys)
    first, last, n = F.col("_upto") - F.col("_n"), F.col("_upto"), F.col("_upto_total")

    def at(index):
        return F.max(F.when((first <= index) & (index < last), F.col("_v")))

    aggregates = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        aggregates += [
            at(low).alias(f"_{name}_lo"),
            at(high).alias(f"_{name}_hi"),
            F.max(place - low).alias(f"_{name}_w"),
        ]
    picked = ranked.groupBy(*keys).agg(*aggregates)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
            ).alias(name)
            for name in probabilities
        ],
    )
