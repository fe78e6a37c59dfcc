"""Running totals, positions and look-backs along an order that spans the whole table.

``Window.orderBy`` without keys, or with one key that holds most rows, puts all those rows in one
task. Here the rows are range partitioned on the order, each range is worked on by itself, and the
totals of the earlier ranges are added. The number of totals is the number of ranges per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.plans.durable import durable

RANGE = "_range"


def null_safe_equal(left: DataFrame, right: DataFrame, keys) -> Column:
    """Equality on all keys that lets null match null (still an equi-join)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def range_ids(df: DataFrame, order, parts: int | None = None) -> DataFrame:
    """Range partition on the order and keep the range number, fixed in a durable copy."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()))


def running_totals(df: DataFrame, order, sums: dict[str, str] | None = None, keys=(), position="_pos",
                   parts: int | None = None) -> DataFrame:
    """Add a 1-based position and running sums along ``order`` inside each key.

    ``sums`` maps a new column to the column it adds up. ``<new>_total`` and ``<position>_total``
    hold the totals of the key. ``order`` must end in a unique tie-breaker.
    """
    sums, keys = sums or {}, list(keys)
    ranged = range_ids(df, [*[F.col(k) for k in keys], *order], parts)

    inner = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*",
        F.count(F.lit(1)).over(inner).alias(position),
        *[F.sum(source).over(inner).alias(name) for name, source in sums.items()],
    )

    by_range = ranged.groupBy(RANGE, *keys).agg(
        F.count(F.lit(1)).alias(position), *[F.sum(source).alias(name) for name, source in sums.items()]
    )
    names = [position, *sums]
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = by_range.select(
        RANGE,
        *keys,
        *[F.sum(n).over(before).alias(f"_{n}_before") for n in names],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
    )
    if not keys:
        offsets = F.broadcast(offsets)  # one row per range
    joined = local.join(offsets, null_safe_equal(local, offsets, [RANGE, *keys]), "left")
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.coalesce(F.col(f"_{n}_before"), F.lit(0)) + local[n]).alias(n) for n in names],
        *[offsets[f"{n}_total"] for n in names],
    )


def with_lookback(df: DataFrame, order, depth: int, build, chunk: int = 100_000) -> DataFrame:
    """Apply window columns that reach at most ``depth`` rows back along a table-wide order.

    Rows are numbered, cut into chunks, and the last ``depth`` rows of a chunk are repeated at the
    head of the next one, so each chunk is one bounded window group. ``build(window)`` returns the
    new columns.
    """
    chunk = max(chunk, depth + 1)
    numbered = running_totals(df, order, position="_pos")
    home = F.floor((F.col("_pos") - 1) / chunk).cast("long")
    offset = (F.col("_pos") - 1) % chunk
    repeated = F.when(offset >= chunk - depth, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(repeated))
    window = Window.partitionBy("_chunk").orderBy("_pos")
    return (
        spread.select("*", *build(window))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk", "_pos", "_pos_total")
    )
