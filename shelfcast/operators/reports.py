"""Aggregates behind the sales, forecast, inventory and store reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.functions.safe import ratio
from shelfcast.functions.stock import priority_rank, stock_health
from shelfcast.operators.ordering import running_totals
from shelfcast.operators.quantiles import exact_quantiles

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


# sales ---------------------------------------------------------------------------------------


def headline(sales: DataFrame, recommendations: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Total sales, critical items and mean turns."""
    total = sales.agg(F.sum(cols.target)).scalar()
    return recommendations.agg(
        F.count_if(F.col("priority") == "Critical").alias("critical_items"),
        F.avg("inventory_turns").alias("mean_turns"),
    ).withColumn("total_sales", total)


def daily_total(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Network total per day: at most one row per calendar day."""
    return sales.groupBy(cols.date).agg(F.sum(cols.target).alias(cols.target))


def last_days(daily: DataFrame, k: int, date: str = "date") -> DataFrame:
    """The last k days."""
    return daily.orderBy(F.col(date).desc()).limit(k)


def monthly_total(sales: DataFrame, cols: PanelColumns = PANEL, span: int = 3) -> DataFrame:
    """Monthly totals with a trailing mean; months without sales count as 0."""
    months = sales.groupBy(F.trunc(cols.date, "MM").alias("month")).agg(F.sum(cols.target).alias(cols.target))
    spine = months.agg(F.min("month").alias("_a"), F.max("month").alias("_b")).select(
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month")
    )
    filled = spine.join(months, "month", "left").withColumn(cols.target, F.coalesce(cols.target, F.lit(0.0)))
    trailing = Window.orderBy("month").rowsBetween(-(span - 1), 0)  # one row per month
    return filled.withColumn("trailing_mean", F.avg(cols.target).over(trailing))


def total_by(df: DataFrame, key: str, value: str, k: int | None = None) -> DataFrame:
    """Totals of one key, largest first, optionally the first k."""
    ranked = df.groupBy(key).agg(F.sum(value).alias(value)).orderBy(F.col(value).desc(), key)
    return ranked.limit(k) if k else ranked


def anomalies(series: DataFrame, value: str = "sales", date: str = "date", window: int = 30,
              threshold: float = 2.8, least: int = 5) -> DataFrame:
    """Flag values far from their centred rolling mean. One row per day."""
    frame = Window.orderBy(date).rowsBetween(-(window // 2), window - window // 2 - 1)
    enough = F.count(value).over(frame) >= least
    z = (F.col(value) - F.avg(value).over(frame)) / (F.stddev_samp(value).over(frame) + F.lit(1e-9))
    flag = F.coalesce(F.when(enough, F.abs(z) > threshold), F.lit(False))
    return series.withColumn("is_anomaly", flag)


def daily_trend(sales: DataFrame, cols: PanelColumns = PANEL, span: int = 14, least: int = 3) -> DataFrame:
    """Daily totals with trailing mean and anomaly flags."""
    flagged = anomalies(daily_total(sales, cols), cols.target, cols.date)
    frame = Window.orderBy(cols.date).rowsBetween(-(span - 1), 0)
    mean = F.when(F.count(cols.target).over(frame) >= least, F.avg(cols.target).over(frame))
    return flagged.withColumn("trailing_mean", mean)


def week_matrix(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Weekday by ISO week totals; the same week of different years adds up."""
    days = daily_total(sales, cols).select(
        F.weekday(cols.date).alias("weekday"), F.weekofyear(cols.date).alias("week"), cols.target
    )
    return days.groupBy("weekday").pivot("week", list(range(1, 54))).agg(F.sum(cols.target))


def composition(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Store by family totals with store totals and the grand total."""
    pairs = sales.groupBy(*cols.series).agg(F.sum(cols.target).alias(cols.target))
    return pairs.rollup(*cols.series).agg(
        F.sum(cols.target).alias(cols.target), F.grouping_id().cast("long").alias("level")
    )


def mean_by_month(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean row by month of the year."""
    return sales.groupBy(F.month(cols.date).alias("month")).agg(F.avg(cols.target).alias("mean_sales"))


def mean_by_weekday(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean row by weekday, Monday first."""
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return (
        sales.groupBy(F.weekday(cols.date).alias("weekday"))
        .agg(F.avg(cols.target).alias("mean_sales"))
        .select("weekday", names[F.col("weekday")].alias("day_name"), "mean_sales")
        .orderBy("weekday")
    )


def distribution_by(sales: DataFrame, key: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Box plot figures per key."""
    quartiles = exact_quantiles(
        sales, cols.target, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, [key]
    )
    return quartiles


def log_histogram(sales: DataFrame, bins: int = 55, cols: PanelColumns = PANEL) -> DataFrame:
    """Counts of log1p(max(target, 0.01)) in equal bins; the top edge belongs to the last bin."""
    logged = sales.select(F.log1p(F.greatest(F.col(cols.target), F.lit(0.01))).alias("_x"))
    low, high = logged.agg(F.min("_x")).scalar(), logged.agg(F.max("_x")).scalar()
    place = F.floor((F.col("_x") - low) / F.nullif((high - low) / F.lit(float(bins)), F.lit(0.0))) + 1
    bucket = F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("long")
    return logged.where(F.col("_x").isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


# forecasts -----------------------------------------------------------------------------------


def forecast_by_day(forecasts: DataFrame, date: str = "date") -> DataFrame:
    """Daily totals with the summed bounds, or a heuristic band when there are none."""
    if {"forecast_lo", "forecast_hi"} <= set(forecasts.columns):
        return forecasts.groupBy(date).agg(
            F.sum("forecast").alias("forecast"),
            F.greatest(F.sum("forecast_lo"), F.lit(0.0)).alias("lo"),
            F.sum("forecast_hi").alias("hi"),
        )
    half = F.lit(1.645) * F.lit(0.10) * F.col("forecast")
    return forecasts.groupBy(date).agg(F.sum("forecast").alias("forecast")).withColumns(
        {"lo": F.greatest(F.col("forecast") - half, F.lit(0.0)), "hi": F.col("forecast") + half}
    )


def history_and_forecast(sales: DataFrame, forecasts: DataFrame, days: int = 60, cols: PanelColumns = PANEL) -> DataFrame:
    """The last days of history stacked on the forecast, told apart by ``kind``."""
    past = last_days(daily_total(sales, cols), days, cols.date).select(
        cols.date, F.lit("history").alias("kind"), F.col(cols.target).alias("value")
    )
    ahead = forecasts.groupBy(cols.date).agg(F.sum("forecast").alias("value")).select(
        cols.date, F.lit("forecast").alias("kind"), "value"
    )
    return past.unionByName(ahead)


# inventory -----------------------------------------------------------------------------------


def priority_mix(recommendations: DataFrame) -> DataFrame:
    """Items per priority and the percentage that needs no attention (neither Critical nor High)."""
    every = Window.partitionBy()  # one row per priority
    counted = recommendations.groupBy("priority").agg(F.count(F.lit(1)).alias("items"))
    calm = F.sum(F.when(F.col("priority").isin("Critical", "High"), 0).otherwise(F.col("items"))).over(every)
    return counted.withColumn("healthy_percent", F.lit(100.0) * ratio(calm, F.sum("items").over(every)))


def critical_items(recommendations: DataFrame, k: int = 5) -> DataFrame:
    """The first k critical items."""
    return (
        recommendations.where(F.col("priority") == "Critical")
        .select("item_id", "current_inventory", "safety_stock")
        .orderBy("item_id")
        .limit(k)
    )


def inventory_headline(recommendations: DataFrame) -> DataFrame:
    """Items, critical ones, pending reorders and mean turns."""
    return recommendations.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("priority") == "Critical").alias("critical_items"),
        F.count_if(F.col("recommended_order") > 0).alias("pending_reorders"),
        F.avg("inventory_turns").alias("mean_turns"),
    )


def reorder_queue(recommendations: DataFrame, k: int = 18) -> DataFrame:
    """The first k items to reorder by priority, with their stock health."""
    health = stock_health(F.col("current_inventory"), F.col("reorder_point"), F.col("safety_stock"))
    return (
        recommendations.where(F.col("recommended_order") > 0)
        .orderBy(priority_rank(F.col("priority")), "item_id")
        .limit(k)
        .select(
            "item_id", "priority", "current_inventory", "reorder_point", "safety_stock", "recommended_order",
            health.alias("stock_health"),
        )
    )


def snapshot(recommendations: DataFrame, columns, key: str = "item_id") -> DataFrame:
    """The wanted columns that exist, ordered by priority when there is one."""
    present = [c for c in columns if c in recommendations.columns]
    ordered = (
        recommendations.orderBy(priority_rank(F.col("priority")), key)
        if "priority" in recommendations.columns
        else recommendations
    )
    return ordered.select(*present)


# stores --------------------------------------------------------------------------------------


def store_matrix(sales: DataFrame, families=None, cols: PanelColumns = PANEL) -> DataFrame:
    """Store by family totals. Without ``families`` they are read from the data first."""
    pairs = sales.groupBy(*cols.series).agg(F.sum(cols.target).alias("_v"))
    return pairs.groupBy(cols.store).pivot(cols.family, families).agg(F.sum("_v"))


def store_matrix_scaled(sales: DataFrame, families=None, cols: PanelColumns = PANEL) -> DataFrame:
    """Store by family totals as a share of each store's largest one."""
    pairs = sales.groupBy(*cols.series).agg(F.sum(cols.target).alias("_v"))
    peak = F.max("_v").over(Window.partitionBy(cols.store))  # one row per family
    scaled = pairs.withColumn("_v", ratio(F.col("_v"), peak))
    return scaled.groupBy(cols.store).pivot(cols.family, families).agg(F.sum("_v"))


def store_ranking(sales: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Total, mean row, std, variation, distance from the network mean and rank per store."""
    daily = sales.groupBy(cols.store, cols.date).agg(
        F.sum(cols.target).alias("_total")
    )
    rows = sales.groupBy(cols.store).agg(
        F.sum(cols.target).alias("total_sales"),
        F.avg(cols.target).alias("avg_row_sales"),
        F.stddev_samp(cols.target).alias("std_row_sales"),
    )
    means = daily.groupBy(cols.store).agg(F.avg("_total").alias("avg_daily_sales"))
    stores = rows.join(means, cols.store)
    ranked = running_totals(
        stores, [F.col("total_sales").desc(), F.col(cols.store)], {"_running": "total_sales"}, position="rank"
    )
    network = F.col("_running_total") / F.col("rank_total")
    return ranked.select(
        F.col("rank").cast("long").alias("rank"),
        cols.store,
        "total_sales",
        "avg_row_sales",
        "avg_daily_sales",
        ratio(F.col("std_row_sales"), F.col("avg_row_sales")).alias("cv"),
        (F.lit(100.0) * ratio(F.col("total_sales") - network, network)).alias("percent_vs_mean"),
    )


def compare_stores(sales: DataFrame, stores, cols: PanelColumns = PANEL, span: int = 30) -> DataFrame:
    """Totals, spread and growth (last against first days) of chosen stores."""
    daily = (
        sales.where(F.col(cols.store).isin(*stores))
        .groupBy(cols.store, cols.date)
        .agg(F.sum(cols.target).alias("_v"))
    )
    w = Window.partitionBy(cols.store)  # one row per calendar day
    placed = daily.withColumns(
        {
            "_first": F.row_number().over(w.orderBy(cols.date)),
            "_last": F.row_number().over(w.orderBy(F.col(cols.date).desc())),
        }
    )
    early = F.avg(F.when(F.col("_first") <= span, F.col("_v")))
    late = F.avg(F.when(F.col("_last") <= span, F.col("_v")))
    return placed.groupBy(cols.store).agg(
        F.sum("_v").alias("total_sales"),
        F.avg("_v").alias("daily_mean"),
        F.max("_v").alias("peak"),
        F.min("_v").alias("low"),
        F.stddev_samp("_v").alias("std"),
        (F.lit(100.0) * (late / F.greatest(early, F.lit(1.0)) - 1)).alias("growth_percent"),
    )
