"""Dataset summaries, consistency checks and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.operators.quantiles import quantiles_of_counts, value_counts
from shelfcast.plans.durable import durable


def _percent(part, whole):
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def summarise(df: DataFrame, date: str | None = "date") -> DataFrame:
    """Rows, columns, nulls per column and date bounds: one row, one pass."""
    aggregates = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    if date and date in df.columns:
        aggregates += [F.min(date).alias("date_min"), F.max(date).alias("date_max")]
    return df.agg(*aggregates)


def column_types(df: DataFrame) -> dict[str, str]:
    """Column types by name."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def calendar_gaps(df: DataFrame, cols: PanelColumns = PANEL, keys=()) -> DataFrame:
    """Days between the first and last date that have no row, overall or per key.

    Both sides hold at most one row per calendar day and key.
    """
    keys = list(keys)
    present = df.select(*keys, F.col(cols.date).alias("_day")).distinct()
    bounds = df.groupBy(*keys).agg(F.min(cols.date).alias("_from"), F.max(cols.date).alias("_to"))
    spine = bounds.where(F.col("_from").isNotNull()).select(
        *keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))).alias("_day")
    )
    return spine.join(present, [*keys, "_day"], "left_anti").withColumnRenamed("_day", cols.date)


def gap_summary(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Count and percentage of calendar days without any row."""
    span = df.groupBy(cols.date).agg(F.lit(1).alias("_d")).agg(
        F.count(F.lit(1)).alias("_present"),
        (F.datediff(F.max(cols.date), F.min(cols.date)) + 1).alias("_expected"),
    )
    missing = F.col("_expected") - F.col("_present")
    return span.select(
        missing.cast("long").alias("missing_dates_count"),
        _percent(missing, F.col("_expected")).alias("missing_dates_percentage"),
    )


def missing_dates(expected: DataFrame, actual: DataFrame, date: str = "date") -> DataFrame:
    """Set difference of two date lists."""
    return expected.select(date).distinct().join(actual.select(date).distinct(), date, "left_anti")


def consistency_checks(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Negative targets, duplicates, date span, gaps and distinct keys in one row.

    The rows are first reduced to distinct rows with their counts; everything else is one
    aggregation of that set, whose distinct counts are reduced map-side.
    """
    reduced = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    totals = reduced.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(F.col(cols.target) < 0, F.col("_n")).otherwise(0)).alias("negative_count"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_count"),
        F.min(cols.date).alias("date_min"),
        F.max(cols.date).alias("date_max"),
        F.count_distinct(F.col(cols.date)).alias("_days"),
        F.count_distinct(F.col(cols.store)).alias("store_count"),
        F.count_distinct(F.col(cols.family)).alias("family_count"),
    )
    span = F.datediff("date_max", "date_min")
    return totals.select(
        "rows",
        "negative_count",
        _percent(F.col("negative_count"), F.col("rows")).alias("negative_percentage"),
        "duplicate_count",
        _percent(F.col("duplicate_count"), F.col("rows")).alias("duplicate_percentage"),
        "date_min",
        "date_max",
        span.alias("total_days"),
        (span + 1 - F.col("_days")).cast("long").alias("missing_dates_count"),
        "store_count",
        "family_count",
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Long table (column, value) of the distinct values of some columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    reduced = df.select(*columns).distinct()
    return reduced.select(F.explode(pairs).alias("_p")).select("_p.column", "_p.value").distinct()


def quality_report(df: DataFrame) -> DataFrame:
    """Shape, missing cells in total and per column, duplicates."""
    reduced = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    nulls = {c: F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)) for c in df.columns}
    totals = reduced.agg(
        F.sum("_n").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        *[e.alias(f"nulls_{c}") for c, e in nulls.items()],
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
    )
    missing = sum((F.col(f"nulls_{c}") for c in df.columns[1:]), F.col(f"nulls_{df.columns[0]}"))
    return totals.select(
        "*",
        missing.alias("missing_total"),
        _percent(missing, F.col("rows") * F.col("columns")).alias("missing_percentage"),
        _percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_percentage"),
    )


def target_profile(df: DataFrame, target: str = "sales") -> DataFrame:
    """Mean, sample std, min, max, median, adjusted skewness and kurtosis of one column.

    The rows are read once, for the count of each value; all figures follow from that table.
    """
    counts = durable(value_counts(df, target))
    n, v = F.col("_n"), F.col("_v")
    mean = counts.agg(F.sum(n * v) / F.sum(n)).scalar()
    off = v - mean
    sums = counts.agg(
        F.sum(n).cast("double").alias("n"),
        (F.sum(n * v) / F.sum(n)).alias("mean"),
        *[F.sum(n * F.pow(off, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)],
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    size, m2, m3, m4 = F.col("n"), F.col("m2"), F.col("m3"), F.col("m4")
    spread = F.nullif(m2, F.lit(0.0))
    g1 = F.sqrt(size) * m3 / F.pow(spread, F.lit(1.5))
    g2 = size * m4 / (spread * spread) - 3
    scale = (size - 1) / F.nullif((size - 2) * (size - 3), F.lit(0.0))
    return sums.select(
        "mean",
        F.sqrt(m2 / F.nullif(size - 1, F.lit(0.0))).alias("std"),
        "min",
        "max",
        F.when(size > 2, F.sqrt(size * (size - 1)) / F.nullif(size - 2, F.lit(0.0)) * g1).alias("skewness"),
        F.when(size > 3, scale * ((size + 1) * g2 + 6)).alias("kurtosis"),
    ).withColumn("median", quantiles_of_counts(counts, {"median": 0.5}).scalar())


def categorical_profile(df: DataFrame, columns) -> DataFrame:
    """Per column: distinct values, most common value and its count (first value on ties)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    # combinations are counted first, so the unpivot multiplies the reduced rows only
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        combos.select(F.explode(pairs).alias("_p"), "_n")
        .groupBy("_p.column", "_p.value")
        .agg(F.sum("_n").alias("_n"))
        .where(F.col("value").isNotNull())
    )
    best = F.min_by(F.struct("value", "_n"), F.struct(-F.col("_n"), F.col("value")))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        best["value"].alias("most_common"),
        best["_n"].alias("most_common_count"),
    )


def input_checks(df: DataFrame, columns) -> DataFrame:
    """Rows and infinite values per feature column: one row, one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"infinite_{c}") for c in columns],
    )


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when a model input is empty."""
    if df.isEmpty():
        raise ValueError("empty model input")
    return df


def page_filter(df: DataFrame, start=None, end=None, stores=None, families=None,
                cols: PanelColumns = PANEL) -> DataFrame:
    """Date range, store list and family list; None or 'All' means no filter."""
    if start is not None:
        df = df.where(F.col(cols.date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(cols.date) <= F.lit(end).cast("date"))
    for name, chosen in ((cols.store, stores), (cols.family, families)):
        if chosen is not None and chosen != "All" and "All" not in chosen:
            df = df.where(F.col(name).isin(*chosen))
    return df


def date_bounds(*tables: DataFrame, date: str = "date") -> DataFrame:
    """First and last date over several dated tables."""
    parts = [t.agg(F.min(date).alias("date_min"), F.max(date).alias("date_max")) for t in tables]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))


# Columns that never become model features, besides target and keys.
NOT_FEATURES = (
    "dcoilwtico", "holiday_locale", "holiday_type", "transactions", "transactions_lag_1", "transactions_lag_7",
    "transactions_ma_7", "transactions_ma_30", "transactions_growth",
)


def feature_columns(df: DataFrame, cols: PanelColumns = PANEL, extra_excluded=()) -> list[str]:
    """Numeric columns that a model may use: no target, keys, raw index or transaction columns."""
    excluded = {*cols.grain, cols.target, *NOT_FEATURES, *extra_excluded}
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded
    ]


def align_columns(df: DataFrame, wanted, keep=()) -> DataFrame:
    """Exactly the wanted columns in their order; absent ones are 0."""
    return df.select(
        *keep,
        *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in wanted],
    )
