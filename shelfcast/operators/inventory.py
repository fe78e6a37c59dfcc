"""Stock decisions over an item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import stock
from shelfcast.functions.safe import ratio
from shelfcast.functions.stats import z_value
from shelfcast.operators.quantiles import exact_quantiles

ORDERING_COST = 50.0
HOLDING_RATE = 0.25
LEAD_TIME = 14
SERVICE_LEVEL = 0.95


def _or_default(df: DataFrame, name: str, default):
    default = default if not isinstance(default, (int, float)) else F.lit(float(default))
    return F.col(name).cast("double") if name in df.columns else default


def forecast_with_stock(forecasts: DataFrame, inventory: DataFrame, on=("item_id",)) -> DataFrame:
    """Inner join of forecasts and stock on the item keys."""
    return forecasts.join(inventory, list(on), "inner")


def forecast_per_item(forecasts: DataFrame, keys, demand: str = "forecast") -> DataFrame:
    """Mean daily forecast per item, so that the stock join is one to one."""
    return forecasts.groupBy(*keys).agg(F.avg(demand).alias(demand))


def optimise_stock(items: DataFrame, ordering_cost: float = ORDERING_COST, holding_rate: float = HOLDING_RATE,
                   level: float = SERVICE_LEVEL, lead_time: float = LEAD_TIME) -> DataFrame:
    """Safety stock, reorder point, order quantity, turns and cost per item in one projection."""
    fallback = F.col("demand").cast("double") if "demand" in items.columns else F.lit(0.0)
    prepared = items.withColumns(
        {
            "_demand": _or_default(items, "forecast", fallback),
            "_stock": _or_default(items, "current_inventory", 0.0),
            "_cost": _or_default(items, "unit_cost", 1.0),
            "_lead": _or_default(items, "lead_time", lead_time),
        }
    )
    prepared = prepared.withColumn("_std", _or_default(items, "forecast_std", F.col("_demand") * F.lit(0.2)))
    safety = stock.safety_stock(F.col("_demand"), F.col("_std"), F.col("_lead"), level)
    order = stock.order_quantity(F.col("_demand") * F.lit(365.0), ordering_cost, holding_rate, F.col("_cost"))
    point = stock.reorder_point(F.col("_demand"), F.col("_lead"), F.col("safety_stock"))
    eoq = F.coalesce(order["eoq"], F.lit(0.0))
    return (
        prepared.withColumn("safety_stock", safety)
        .withColumn("reorder_point", point)
        .select(
            "item_id",
            F.col("_stock").alias("current_inventory"),
            F.col("_demand").alias("demand_forecast"),
            F.col("_std").alias("demand_std"),
            "safety_stock",
            "reorder_point",
            eoq.alias("eoq"),
            F.when(F.col("_stock") <= F.col("reorder_point"), eoq).otherwise(F.lit(0.0)).alias("recommended_order"),
            (F.col("_demand") * F.lit(365.0) / F.greatest(F.col("_stock"), F.lit(1.0))).alias("inventory_turns"),
            F.lit(level).alias("service_level"),
            F.coalesce(order["total_cost_per_year"], F.lit(0.0)).alias("total_cost"),
            F.col("_cost").alias("unit_cost"),
        )
    )


def annual_value(results: DataFrame, demand: str = "demand_forecast", unit_value: float = 10.0) -> DataFrame:
    """Yearly value of the forecast demand."""
    return results.withColumn("annual_value", F.col(demand) * F.lit(365.0) * F.lit(float(unit_value)))


def optimisation_totals(results: DataFrame) -> DataFrame:
    """Recommended units, stock value, mean turns and items to reorder."""
    return results.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.sum("recommended_order").alias("recommended_units"),
        F.sum(F.col("current_inventory") * F.col("unit_cost")).alias("inventory_value"),
        F.avg("inventory_turns").alias("mean_turns"),
        F.count_if(F.col("recommended_order") > 0).alias("items_to_reorder"),
    )


# Priority, action and reason of a recommendation, first matching rule wins.
BELOW_SAFETY = ("Critical", "Emergency Order", "Below safety stock")
BELOW_REORDER = ("High", "Place Order", "Below reorder point")
SLOW_MOVING = ("Low", "Reduce Stock", "Low inventory turnover")
IN_ORDER = ("Medium", "Monitor", "Normal inventory levels")
SLOW_TURNS = 4


def recommend(results: DataFrame) -> DataFrame:
    """Priority, action and reason per item, first rule that matches."""
    low_stock = F.col("current_inventory") <= F.col("safety_stock")
    reorder = F.col("current_inventory") <= F.col("reorder_point")
    slow = F.col("inventory_turns") < SLOW_TURNS

    def part(i):
        return (
            F.when(low_stock, BELOW_SAFETY[i]).when(reorder, BELOW_REORDER[i]).when(slow, SLOW_MOVING[i])
            .otherwise(IN_ORDER[i])
        )

    return results.withColumns(
        {"priority": part(0), "action": part(1), "reason": part(2), "priority_rank": stock.priority_rank(part(0))}
    )


def by_priority(recommendations: DataFrame, key: str = "item_id") -> DataFrame:
    """Order by priority rank, then item."""
    return recommendations.orderBy(stock.priority_rank(F.col("priority")), key)


def order_plan(items: DataFrame, budget: float | None = 1_000_000.0, storage: float | None = 10_000.0) -> DataFrame:
    """Cheapest order quantities that cover safety stock plus reorder point.

    The cost of an item grows with its quantity, so the cheapest plan orders exactly the lower
    bound. The plan is feasible when its value and volume stay within budget and storage; the
    quantities of an infeasible plan are null. Prices and holding costs must not be negative.
    """
    cost, holding = _or_default(items, "unit_cost", 1.0), _or_default(items, "holding_cost", 0.25)
    bound = _or_default(items, "safety_stock", 0.0) + _or_default(items, "reorder_point", 0.0)
    wrong = (cost < 0) | (holding < 0)
    checked = F.when(wrong, F.raise_error(F.lit("negative price or holding cost"))).otherwise(
        F.greatest(F.lit(0.0), bound)
    )
    planned = items.withColumns(
        {"_q": checked.cast("double"), "_unit_cost": cost, "_weight": cost + holding / F.lit(2.0)}
    )
    within = F.lit(True)
    if budget is not None:
        within = within & (F.sum(F.col("_q") * F.col("_unit_cost")) <= F.lit(float(budget)))
    if storage is not None:
        within = within & (F.sum("_q") <= F.lit(float(storage)))
    feasible = planned.agg(within).scalar()
    return planned.withColumn("_ok", feasible).select(
        *items.columns,
        F.when(F.col("_ok"), "optimal").otherwise("infeasible").alias("status"),
        F.when(F.col("_ok"), F.col("_q")).alias("optimal_order_quantity"),
        F.when(F.col("_ok"), F.col("_q") * F.col("_weight")).alias("order_cost"),
    )


def order_plan_totals(plan: DataFrame) -> DataFrame:
    """Status, total cost and total quantity of a plan."""
    return plan.groupBy("status").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("optimal_order_quantity").alias("total_quantity"),
        F.sum("order_cost").alias("optimal_total_cost"),
    )


def inventory_kpis(items: DataFrame, holding_rate: float = HOLDING_RATE) -> DataFrame:
    """Turnover, fill rate, carrying cost and class shares, each only if its columns exist."""
    have, out = set(items.columns), [F.count(F.lit(1)).alias("items")]
    if {"annual_demand", "average_inventory"} <= have:
        out.append(
            (F.sum("annual_demand") / F.greatest(F.sum("average_inventory"), F.lit(1.0))).alias("inventory_turnover")
        )
    if {"stockouts", "total_orders"} <= have:
        orders = F.sum("total_orders").cast("double")
        out.append(((orders - F.sum("stockouts")) / F.greatest(orders, F.lit(1.0))).alias("fill_rate"))
    if "inventory_value" in have:
        out.append((F.sum("inventory_value") * F.lit(holding_rate)).alias("carrying_cost"))
    if "abc_class" in have:
        for name in ("A", "B", "C"):
            share = F.lit(100.0) * F.count_if(F.col("abc_class") == name) / F.nullif(F.count(F.lit(1)), F.lit(0))
            out.append(share.alias(f"{name.lower()}_percent"))
    return items.agg(*out)


# safety stock over history -------------------------------------------------------------------


def seasonal_safety_stock(history: DataFrame, keys, order: str, demand: str, lead_time: float,
                          level: float = SERVICE_LEVEL, season: int = 365) -> DataFrame:
    """Safety stock per position in the season; one base row (period -1) for short histories.

    ``history`` has one row per key and date.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    placed = history.select(
        *keys,
        F.col(demand).alias("_d"),
        (F.row_number().over(w.orderBy(order)) - 1).alias("_i"),
        F.count(F.lit(1)).over(w).alias("_n"),
    )
    short = F.col("_n") < 2 * season
    grouped = placed.groupBy(*keys, F.when(short, F.lit(-1)).otherwise(F.col("_i") % season).alias("period")).agg(
        F.avg("_d").alias("demand_mean"),
        F.stddev_pop("_d").alias("_pop"),
        F.stddev_samp("_d").alias("_samp"),
    )
    std = F.when(F.col("period") == -1, F.coalesce("_samp", F.lit(0.0))).otherwise(F.col("_pop"))
    return grouped.select(
        *keys,
        F.col("period").cast("long").alias("period"),
        "demand_mean",
        std.alias("demand_std"),
        stock.safety_stock(F.col("demand_mean"), std, lead_time, level).alias("safety_stock"),
    )


def dynamic_safety_stock(forecasts: DataFrame, keys, order: str, lead_time: float,
                         forecast: str = "forecast", error: str = "error", window: int = 30) -> DataFrame:
    """Safety stock whose level follows the spread of the last errors, current one excluded.

    ``forecasts`` has one row per key and date. The first row counts as error 0, a single error as
    its absolute value.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    recent = w.rowsBetween(-window, -1)
    f = F.col(forecast).cast("double")
    n, first = F.count(F.lit(1)).over(recent), F.max(F.abs(F.col(error))).over(recent)
    spread = F.when(n == 0, F.lit(0.0)).when(n == 1, first).otherwise(F.stddev_pop(error).over(recent))
    measured = forecasts.withColumn("error_std", F.coalesce(spread, F.abs(f) * F.lit(0.1)))
    relative = F.col("error_std") / F.greatest(f, F.lit(1.0))
    level = F.when(relative < 0.1, 0.90).when(relative < 0.2, 0.95).otherwise(0.99)
    z = F.when(relative < 0.1, z_value(0.90)).when(relative < 0.2, z_value(0.95)).otherwise(z_value(0.99))
    stocked = F.when(
        F.coalesce((f > 0) & F.lit(lead_time > 0), F.lit(False)),
        F.greatest(F.lit(0.0), z * F.col("error_std") * F.sqrt(F.lit(float(lead_time)))),
    ).otherwise(F.lit(0.0))
    return measured.withColumns({"service_level": level, "safety_stock": stocked})


def dynamic_reorder_point(forecasts: DataFrame, keys, order: str, lead_time: float, safety: float,
                          forecast: str = "forecast") -> DataFrame:
    """Forecast demand over the lead time plus safety stock; short horizons extended by their mean.

    ``forecasts`` has one row per key and date of the horizon.
    """
    keys = list(keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) <= int(lead_time)
    used = F.when(first, F.col(forecast))
    sums = forecasts.select(*keys, used.alias("_f")).groupBy(*keys).agg(
        F.coalesce(F.sum("_f"), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.avg("_f"), F.lit(0.0)).alias("_mean"),
        F.count("_f").alias("_n"),
    )
    rest = F.greatest(F.lit(float(lead_time)) - F.col("_n"), F.lit(0.0))
    demand = F.col("_sum") + F.col("_mean") * rest
    point = F.greatest(F.lit(0.0), demand + F.lit(float(safety))) if lead_time > 0 else F.lit(float(safety))
    return sums.select(*keys, demand.alias("lead_time_demand"), point.alias("reorder_point"))


def safety_stock_report(items: DataFrame, level: float = SERVICE_LEVEL, lead_time: float = LEAD_TIME) -> DataFrame:
    """Basic, class-based and cost-optimal safety stock and its value per item."""
    have = set(items.columns)
    m, s = _or_default(items, "demand_mean", 10.0), _or_default(items, "demand_std", 3.0)
    lead, cost = _or_default(items, "lead_time", lead_time), _or_default(items, "unit_cost", 1.0)
    label = F.col("abc_class") if "abc_class" in have else F.lit("B")
    basic = stock.safety_stock(m, s, lead, level)
    if {"holding_cost_rate", "stockout_cost"} <= have:
        best = F.array_min(
            stock.level_costs(m, s, lead, F.col("holding_cost_rate"), F.col("stockout_cost"), cost)
        )
        best = best["safety_stock"]
    else:
        best = F.col("basic_safety_stock")
    current = F.col("current_safety_stock") if "current_safety_stock" in have else F.col("basic_safety_stock")
    return (
        items.withColumn("basic_safety_stock", basic)
        .withColumn("optimal_safety_stock", best)
        .select(
            "item_id",
            "basic_safety_stock",
            stock.safety_stock_by_class(m, s, lead, label).alias("abc_safety_stock"),
            "optimal_safety_stock",
            current.alias("current_safety_stock"),
            (F.col("optimal_safety_stock") * cost).alias("safety_stock_value"),
            F.lit(level).alias("service_level"),
        )
    )


def safety_stock_summary(report: DataFrame) -> DataFrame:
    """Totals of a safety stock report."""
    return report.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.sum("safety_stock_value").alias("total_safety_stock_value"),
        F.avg("optimal_safety_stock").alias("average_safety_stock"),
        F.min("optimal_safety_stock").alias("min_safety_stock"),
        F.max("optimal_safety_stock").alias("max_safety_stock"),
    )


def safety_stock_alerts(report: DataFrame) -> DataFrame:
    """Items above the 90th percentile of stock or the 80th of value, with the kind of alert."""
    high = exact_quantiles(report, "optimal_safety_stock", {"q": 0.9}).scalar()
    costly = exact_quantiles(report, "safety_stock_value", {"q": 0.8}).scalar()
    kinds = F.array_compact(
        F.array(
            F.when(F.col("optimal_safety_stock") > high, F.lit("high_safety_stock")),
            F.when(F.col("safety_stock_value") > costly, F.lit("high_value_safety_stock")),
        )
    )
    return report.select("item_id", "optimal_safety_stock", "safety_stock_value", F.explode(kinds).alias("alert"))


def with_stock_defaults(items: DataFrame) -> DataFrame:
    """Safety stock 0.35 x reorder point and lead time 14 where the columns are absent."""
    out = {}
    if "safety_stock" not in items.columns and "reorder_point" in items.columns:
        out["safety_stock"] = F.col("reorder_point") * F.lit(0.35)
    if "lead_time" not in items.columns:
        out["lead_time"] = F.lit(LEAD_TIME)
    return items.withColumns(out) if out else items


# scenarios -----------------------------------------------------------------------------------


def scenario_baseline(inventory: DataFrame) -> DataFrame:
    """Demand profile that the mean stock level stands for: one row."""
    mean = F.avg("current_inventory") * F.lit(0.3)
    return inventory.agg(
        mean.alias("demand_mean"),
        (mean * F.lit(0.25)).alias("demand_std"),
        F.avg("unit_cost").alias("unit_cost"),
    )


def compare_scenarios(base: dict, new: dict):
    """Percent change per output, null where the baseline is 0."""
    return {k: F.lit(100.0) * ratio(new[k] - base[k], base[k]) for k in base}


def level_sweep(items: DataFrame, levels, mean, std, lead_time, ordering_cost, holding_rate, unit_cost) -> DataFrame:
    """Cost and stock of each item at each service level (a fixed short list)."""
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(z_value(p)).alias("z")) for p in levels])
    swept = items.withColumn("_g", F.explode(grid))
    out = stock.scenario(mean, std, lead_time, None, ordering_cost, holding_rate, unit_cost, z=F.col("_g.z"))
    return swept.select(
        "item_id",
        F.col("_g.p").alias("service_level"),
        out["safety_stock"].alias("safety_stock"),
        out["total_cost"].alias("total_cost"),
    )


def ordering_cost_sweep(items: DataFrame, costs, mean, std, lead_time, level, holding_rate, unit_cost) -> DataFrame:
    """Holding, ordering and total cost of each item at each ordering cost (a fixed short list)."""
    swept = items.withColumn("ordering_cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    out = stock.scenario(mean, std, lead_time, level, F.col("ordering_cost"), holding_rate, unit_cost)
    return swept.select(
        "item_id",
        "ordering_cost",
        out["holding_cost"].alias("holding_cost"),
        out["order_cost_yr"].alias("order_cost_yr"),
        out["total_cost"].alias("total_cost"),
    )
