"""Point clipping, interval bands and weighted ensembles of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.stats import z_value
from shelfcast.operators.quantiles import exact_quantiles

QUANTILES = ("forecast_lo", "forecast_md", "forecast_hi")


def clip_points(df: DataFrame, column: str = "prediction") -> DataFrame:
    """No negative forecasts."""
    return df.withColumn(column, F.greatest(F.col(column), F.lit(0.0)))


def sorted_quantiles(*values: Column) -> list[Column]:
    """Clip at 0 and sort, so that quantiles never cross."""
    ordered = F.array_sort(F.array(*[F.greatest(v, F.lit(0.0)) for v in values]))
    return [ordered[i] for i in range(len(values))]


def straighten(df: DataFrame, columns=QUANTILES) -> DataFrame:
    """Clip and sort quantile columns of a table."""
    columns = list(columns)
    fixed = sorted_quantiles(*[F.col(c) for c in columns])
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(c) for v, c in zip(fixed, columns)])


def normal_interval(df: DataFrame, confidence: float = 0.95, spread: float | Column | None = None,
                    column: str = "prediction") -> DataFrame:
    """Symmetric interval. The spread is given (residual std) or a tenth of the predictions' std."""
    if spread is None:
        spread = df.agg(F.stddev_pop(column)).scalar() * F.lit(0.1)
    width = F.lit(z_value(0.5 + confidence / 2)) * (spread if isinstance(spread, Column) else F.lit(float(spread)))
    return df.withColumns(
        {"lower": F.greatest(F.col(column) - width, F.lit(0.0)), "upper": F.col(column) + width}
    )


def heuristic_band(df: DataFrame, share: float = 0.1, column: str = "prediction") -> DataFrame:
    """Band of plus and minus a share of the prediction."""
    p = F.col(column)
    return df.withColumns({"lower": p * F.lit(1 - share), "upper": p * F.lit(1 + share)})


def residual_offsets(residuals: DataFrame, keys, residual: str = "residual") -> DataFrame:
    """P10, P50 and P90 of holdout residuals per key."""
    return exact_quantiles(residuals, residual, {"r10": 0.1, "r50": 0.5, "r90": 0.9}, keys)


LEVELS = ("series", "group", "all")


def pooled_offsets(residuals: DataFrame, keys, residual: str = "residual", least: int = 30) -> DataFrame:
    """Offsets per key, and two wider pools for keys that have none of their own.

    ``level`` is series for keys with at least ``least`` residuals, group for the first key alone (the
    others null), all for the whole table (all keys null).
    """
    keys = list(keys)
    counted = residuals.groupBy(*keys).agg(F.count(residual).alias("_n")).where(F.col("_n") >= least).select(*keys)
    own = residual_offsets(residuals, keys, residual).join(counted, keys, "left_semi")
    group = residual_offsets(residuals, keys[:1], residual)
    kinds = {f.name: f.dataType for f in residuals.schema.fields}
    empty = lambda names: [F.lit(None).cast(kinds[k]).alias(k) for k in names]
    offs = ["r10", "r50", "r90"]
    every = exact_quantiles(residuals, residual, {"r10": 0.1, "r50": 0.5, "r90": 0.9})
    parts = [
        own.select(*keys, *offs, F.lit(LEVELS[0]).alias("level")),
        group.select(keys[0], *empty(keys[1:]), *offs, F.lit(LEVELS[1]).alias("level")),
        every.select(*empty(keys), *offs, F.lit(LEVELS[2]).alias("level")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def residual_quantiles(points: DataFrame, offsets: DataFrame, keys, column: str = "prediction") -> DataFrame:
    """Quantile forecasts: the point plus the residual quantiles of its key, and the ``level`` they come from.

    With offsets from :func:`pooled_offsets` a key without offsets takes those of its group, else those
    of all. Plain offsets per key leave the quantiles of an unknown key null: nothing is known of them.
    """
    keys, names = list(keys), ["r10", "r50", "r90"]
    if "level" not in offsets.columns:
        joined = points.join(offsets, keys, "left").withColumn("level", F.when(F.col("r50").isNotNull(), LEVELS[0]))
    else:
        def at(level: str, on) -> DataFrame:
            part = offsets.where(F.col("level") == level).select(*on, *names)
            return part.select(*on, F.struct(*names).alias(f"_{level}"))

        joined = points.join(at("series", keys), keys, "left").join(at("group", keys[:1]), keys[:1], "left")
        joined = joined.withColumn("_all", offsets.where("level = 'all'").agg(F.first(F.struct(*names))).scalar())
        best = F.coalesce(*[F.col(f"_{v}") for v in LEVELS])
        found = F.coalesce(*[F.when(F.col(f"_{v}").isNotNull(), v) for v in LEVELS])
        joined = joined.withColumns({**{n: best[n] for n in names}, "level": found}).drop(*[f"_{v}" for v in LEVELS])
    known = F.col("r50").isNotNull()
    fixed = sorted_quantiles(*[F.col(column) + F.col(n) for n in names])
    return joined.withColumns({q: F.when(known, f) for q, f in zip(QUANTILES, fixed)}).drop(*names)


def ensemble_weights(names, weights=None) -> dict[str, float]:
    """Weights divided by their sum; a missing weight is 1; equal ones when they sum to 0."""
    given = {n: float((weights or {}).get(n, 1.0)) for n in names}
    total = sum(given.values())
    return {n: (w / total if total else 1.0 / len(given)) for n, w in given.items()}


def combine(members: dict[str, DataFrame], keys, weights=None, columns=("prediction",)) -> DataFrame:
    """Weighted mean of the members' columns, row by row on the keys.

    Members are stacked and summed per key: one shuffle whatever the number of members.
    """
    share, keys, columns = ensemble_weights(members, weights), list(keys), list(columns)
    stacked = None
    for name, df in members.items():
        part = df.select(*keys, *[(F.col(c) * F.lit(share[name])).alias(c) for c in columns])
        stacked = part if stacked is None else stacked.unionByName(part)
    summed = stacked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_members"), *[F.sum(c).alias(c) for c in columns]
    )
    complete = summed.where(F.col("_members") == len(members)).drop("_members")
    if len(columns) > 1:
        return straighten(complete, columns)
    return clip_points(complete, columns[0])
