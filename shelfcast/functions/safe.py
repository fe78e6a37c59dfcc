"""NaN and division handling. Missing is always null inside the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (one projection)."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(numerator, denominator) -> Column:
    """a / b, null when b is 0 or either side is null."""
    a = numerator if isinstance(numerator, Column) else F.lit(numerator)
    b = denominator if isinstance(denominator, Column) else F.lit(denominator)
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null when either side does not vary."""
    x, y = x.cast("double"), y.cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return ratio(F.covar_pop(x, y), spread)
