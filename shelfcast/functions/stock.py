"""Stock formulas as column expressions. Every argument is a column or a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.functions.safe import ratio
from shelfcast.functions.stats import normal_quantile, z_value

DAYS_PER_YEAR = 365.0

# Service level by ABC class, and the level of any other class.
ABC_SERVICE_LEVELS = {"A": 0.99, "B": 0.95, "C": 0.90}
ABC_DEFAULT_LEVEL = 0.95

# Priority ranks of stock recommendations.
PRIORITY_RANKS = {"Critical": 1, "High": 2, "Medium": 3, "Low": 4}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def level_quantile(level) -> Column:
    """z of a service level: a literal for a number, an expression for a column."""
    return normal_quantile(level) if isinstance(level, Column) else F.lit(z_value(level))


def _when_valid(valid: Column, value: Column, otherwise: float | None = 0.0) -> Column:
    other = F.lit(otherwise).cast("double")
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(other)


def safety_stock(mean, std, lead_time, level=0.95) -> Column:
    """z * std * sqrt(lead time), at least 0; 0 for bad input."""
    m, s, lead = _c(mean), _c(std), _c(lead_time)
    valid = (m > 0) & (s >= 0) & (lead > 0)
    return _when_valid(valid, F.greatest(F.lit(0.0), level_quantile(level) * s * F.sqrt(lead)))


def safety_stock_variable_lead(mean, std, lead_mean, lead_std, level=0.95) -> Column:
    """Safety stock when the lead time itself varies."""
    m, s, lead, lead_s = _c(mean), _c(std), _c(lead_mean), _c(lead_std)
    valid = (m > 0) & (s >= 0) & (lead > 0) & (lead_s >= 0)
    spread = F.sqrt(lead * s * s + m * m * lead_s * lead_s)
    return _when_valid(valid, F.greatest(F.lit(0.0), level_quantile(level) * spread))


def safety_stock_periodic(mean, std, lead_time, review_period, level=0.95) -> Column:
    """Safety stock that also covers the review period."""
    m, s, lead, review = _c(mean), _c(std), _c(lead_time), _c(review_period)
    valid = (m > 0) & (s >= 0) & (lead > 0) & (review > 0)
    return _when_valid(valid, F.greatest(F.lit(0.0), level_quantile(level) * s * F.sqrt(lead + review)))


def safety_stock_by_class(mean, std, lead_time, abc_class: Column) -> Column:
    """Safety stock at the service level of the ABC class."""
    z = F.lit(z_value(ABC_DEFAULT_LEVEL))
    for name, level in ABC_SERVICE_LEVELS.items():
        z = F.when(abc_class == name, F.lit(z_value(level))).otherwise(z)
    m, s, lead = _c(mean), _c(std), _c(lead_time)
    valid = (m > 0) & (s >= 0) & (lead > 0)
    return _when_valid(valid, F.greatest(F.lit(0.0), z * s * F.sqrt(lead)))


def safety_stock_shortage(mean, std, lead_time, factor=1.2, level=0.99) -> Column:
    """Safety stock when demand is inflated by shortage ordering."""
    return safety_stock(_c(mean) * _c(factor), _c(std) * _c(factor), lead_time, level)


def reorder_point(demand, lead_time, safety) -> Column:
    """Demand over the lead time plus safety stock; safety stock alone for bad input."""
    d, lead, ss = _c(demand), _c(lead_time), _c(safety)
    valid = F.coalesce((d > 0) & (lead > 0), F.lit(False))
    return F.when(valid, F.greatest(F.lit(0.0), d * lead + ss)).otherwise(ss)


def order_quantity(demand, ordering_cost, holding_rate, unit_cost) -> dict[str, Column]:
    """Economic order quantity and its yearly costs; all null when an input is not positive."""
    d, k, h, c = _c(demand), _c(ordering_cost), _c(holding_rate), _c(unit_cost)
    valid = F.coalesce((d > 0) & (k > 0) & (h > 0) & (c > 0), F.lit(False))
    unit_holding = h * c
    q = F.sqrt(F.lit(2.0) * d * k / F.nullif(unit_holding, F.lit(0.0)))
    q = F.when(valid, q)
    ordering = ratio(d, q) * k
    holding = q / F.lit(2.0) * unit_holding
    orders = ratio(d, q)
    return {
        "eoq": q,
        "ordering_cost_per_year": ordering,
        "holding_cost_per_year": holding,
        "total_cost_per_year": ordering + holding,
        "orders_per_year": orders,
        "cycle_days": ratio(F.lit(DAYS_PER_YEAR), orders),
    }


def cheapest_tier(demand, ordering_cost, holding_rate, tiers: Column) -> Column:
    """Best quantity-discount tier of an array<struct<quantity, unit_cost>> column.

    Each tier orders max(EOQ at its price, its threshold). The lowest total wins, the smaller
    threshold on ties. Works inside the row, so no rows are multiplied and nothing is shuffled.
    Result: struct<total_cost, threshold, order_quantity, unit_cost>, null without a valid tier.
    """
    d, k, h = _c(demand), _c(ordering_cost), _c(holding_rate)

    def price(tier: Column) -> Column:
        c, threshold = tier["unit_cost"].cast("double"), tier["quantity"].cast("double")
        unit_holding = F.nullif(h * c, F.lit(0.0))
        q = F.greatest(F.sqrt(F.lit(2.0) * d * k / unit_holding), threshold)
        total = d * c + ratio(d, q) * k + q / F.lit(2.0) * h * c
        return F.struct(
            total.alias("total_cost"),
            threshold.alias("threshold"),
            q.alias("order_quantity"),
            c.alias("unit_cost"),
        )

    usable = F.filter(tiers, lambda t: t["unit_cost"].cast("double") > 0)
    valid = F.coalesce((d > 0) & (k > 0) & (h > 0), F.lit(False))
    return F.when(valid, F.array_min(F.transform(usable, price)))


def service_level_grid(first: float = 0.50, last: float = 0.99, step: float = 0.01) -> list[float]:
    """Evenly stepped service levels, both ends included."""
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


def level_costs(mean, std, lead_time, holding_rate, stockout_cost, unit_cost, levels=None) -> Column:
    """Cost of every service level as array<struct>, cheapest findable with array_min."""
    levels = levels or service_level_grid()
    grid = F.array(
        *[F.struct(F.lit(p).alias("service_level"), F.lit(z_value(p)).alias("z")) for p in levels]
    )
    m, s, lead = _c(mean), _c(std), _c(lead_time)
    h, stockout, c = _c(holding_rate), _c(stockout_cost), _c(unit_cost)
    valid = F.coalesce((m > 0) & (s >= 0) & (lead > 0), F.lit(False))

    def cost(point: Column) -> Column:
        stock = F.when(valid, F.greatest(F.lit(0.0), point["z"] * s * F.sqrt(lead))).otherwise(F.lit(0.0))
        holding = stock * c * h
        risk = (F.lit(1.0) - point["service_level"]) * stockout * ratio(F.lit(DAYS_PER_YEAR), lead)
        return F.struct(
            (holding + risk).alias("total_cost"),
            point["service_level"].alias("service_level"),
            stock.alias("safety_stock"),
            holding.alias("holding_cost"),
            risk.alias("stockout_cost"),
        )

    return F.transform(grid, cost)


def scenario(mean, std, lead_time, level, ordering_cost, holding_rate, unit_cost, z=None) -> dict[str, Column]:
    """What-if stock plan for one set of parameters."""
    m, s, lead = _c(mean), _c(std), _c(lead_time)
    k, h, c = _c(ordering_cost), _c(holding_rate), _c(unit_cost)
    z = level_quantile(level) if z is None else z
    yearly = F.lit(DAYS_PER_YEAR) * m
    stock = F.greatest(F.lit(0.0), z * s * F.sqrt(lead))
    q = F.sqrt(F.greatest(F.lit(1.0), ratio(F.lit(2.0) * yearly * k, h * c)))
    holding = (q / F.lit(2.0) + stock) * c * h
    ordering = ratio(yearly, q) * k
    return {
        "safety_stock": stock,
        "eoq": q,
        "reorder_point": m * lead + stock,
        "holding_cost": holding,
        "order_cost_yr": ordering,
        "total_cost": holding + ordering,
    }


def stock_health(current, reorder, safety) -> Column:
    """Stock health from 0 to 100, piecewise linear around safety stock and reorder point."""
    x, r, s = _c(current), _c(reorder), _c(safety)
    one, zero, top = F.lit(1.0), F.lit(0.0), F.lit(100.0)
    return (
        F.when(x <= s, F.greatest(zero, x / F.greatest(s, one) * F.lit(20.0)))
        .when(x <= r, F.lit(20.0) + (x - s) / F.greatest(r - s, one) * F.lit(30.0))
        .otherwise(F.least(top, F.lit(50.0) + (x - r) / F.greatest(r, one) * F.lit(50.0)))
    )


def priority_rank(priority: Column) -> Column:
    """Sort rank of a recommendation priority; unknown ones go last."""
    rank = F.lit(len(PRIORITY_RANKS) + 1)
    for name, value in PRIORITY_RANKS.items():
        rank = F.when(priority == name, F.lit(value)).otherwise(rank)
    return rank
