"""ABC and XYZ classes and Pareto curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.safe import ratio
from shelfcast.operators.ordering import running_totals


def running_share(items: DataFrame, value: str, key: str, share: str = "cumulative_share") -> DataFrame:
    """Running sum and share of the total by value descending; ties by key."""
    ranked = running_totals(
        items, [F.col(value).desc_nulls_last(), F.col(key).asc()], {"cumulative_value": value}, position="value_rank"
    )
    return ranked.withColumn(share, ratio(F.col("cumulative_value"), F.col("cumulative_value_total")))


def abc_label(share, a_threshold=0.8, b_threshold=0.95):
    """A up to the first threshold of the running share, B up to the second, else C."""
    return F.when(share <= a_threshold, "A").when(share <= b_threshold, "B").otherwise("C")


def abc_classes(items: DataFrame, value: str = "annual_value", key: str = "item_id",
                a_threshold: float = 0.8, b_threshold: float = 0.95) -> DataFrame:
    """Items with ``cumulative_value``, ``cumulative_share`` and ``abc_class``."""
    shared = running_share(items, value, key)
    return shared.select(
        *items.columns,
        "cumulative_value",
        "cumulative_share",
        abc_label(F.col("cumulative_share"), a_threshold, b_threshold).alias("abc_class"),
    )


def abc_statistics(classified: DataFrame, value: str = "annual_value") -> DataFrame:
    """Count, value and last running share per class."""
    return classified.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum(value).alias("total_value"),
        F.max("cumulative_share").alias("max_cumulative_share"),
    )


def xyz_classes(items: DataFrame, demand: str = "demand", std: str = "demand_std",
                x_threshold: float = 0.2, y_threshold: float = 0.5) -> DataFrame:
    """Class by coefficient of variation: X steady, Y variable, Z erratic.

    Without a std column the std is 0.3 x demand. 0/0 counts as 0 (X) and x/0 as infinite (Z).
    """
    if std not in items.columns:
        items = items.withColumn(std, F.col(demand) * F.lit(0.3))
    d, s = F.col(demand), F.col(std)
    cv = F.when((d == 0) & (s != 0), F.lit(float("inf"))).otherwise(F.coalesce(ratio(s, d), F.lit(0.0)))
    label = F.when(F.col("cv") <= x_threshold, "X").when(F.col("cv") <= y_threshold, "Y").otherwise("Z")
    return items.withColumn("cv", cv).withColumn("xyz_class", label)


def xyz_statistics(classified: DataFrame, demand: str = "demand") -> DataFrame:
    """Variation and demand figures per class."""
    return classified.groupBy("xyz_class").agg(
        F.count("cv").alias("cv_count"),
        F.avg("cv").alias("cv_mean"),
        F.stddev_samp("cv").alias("cv_std"),
        F.avg(demand).alias("demand_mean"),
        F.sum(demand).alias("demand_sum"),
    )


def pareto(items: DataFrame, value: str, key: str = "item_id") -> DataFrame:
    """Cumulative percent of value and of items, with the class; largest value first."""
    shared = running_share(items, value, key)
    return shared.select(
        *items.columns,
        (F.col("cumulative_share") * 100).alias("cumulative_percent"),
        (F.lit(100.0) * F.col("value_rank") / F.col("value_rank_total")).alias("item_percent"),
        abc_label(F.col("cumulative_share")).alias("abc_class"),
    )


def pareto_summary(curve: DataFrame, value: str) -> DataFrame:
    """Items, value and percent of value per class (a handful of rows)."""
    total = curve.agg(F.sum(value)).scalar()
    return curve.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("items"), F.sum(value).alias("value")
    ).withColumn("value_percent", F.lit(100.0) * ratio(F.col("value"), total))


def number_items(df: DataFrame, keys, name: str = "item_id") -> DataFrame:
    """Distinct keys numbered from 0 in key order."""
    distinct = df.select(*keys).dropDuplicates(list(keys))
    numbered = running_totals(distinct, [F.col(k) for k in keys], position="_n")
    return numbered.select((F.col("_n") - 1).cast("long").alias(name), *keys)
