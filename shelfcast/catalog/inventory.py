"""Stock queries."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import b, r, with_
from shelfcast.functions import stock
from shelfcast.functions.stats import z_value
from shelfcast.operators import classify, inventory

Z = {p: repr(z_value(p)) for p in (0.90, 0.95, 0.99)}


def dbl(x) -> str:
    """A double literal (bare decimals are DECIMAL in the checking engine)."""
    return f"CAST({x!r} AS DOUBLE)"


def z_sql(level: float) -> str:
    return f"CAST({z_value(level)!r} AS DOUBLE)"


def ss_sql(mean, std, lead, z) -> str:
    return f"CASE WHEN {mean} > 0 AND {std} >= 0 AND {lead} > 0 THEN greatest(0, {z} * {std} * sqrt({lead})) ELSE 0 END"


def eoq_sql(demand, k, h, c) -> str:
    return f"CASE WHEN {demand} > 0 AND {c} > 0 THEN sqrt(2 * {demand} * {k} / ({dbl(h)} * {c})) END"


ITEM_KEY = b("item_id", "item_id")

# order quantities

EOQ = f"eoq AS (SELECT *, demand_mean * 365 AS d, {eoq_sql('demand_mean * 365', 50, 0.25, 'unit_cost')} AS q FROM items)"


@query(
    "M1_order_quantity",
    with_(
        [src.ITEMS, EOQ],
        f"""SELECT item_id, {r('q', 'eoq')}, {r('d / q * 50', 'ordering_cost_per_year')},
        {r('q / 2 * 0.25 * unit_cost', 'holding_cost_per_year')},
        {r('d / q * 50 + q / 2 * 0.25 * unit_cost', 'total_cost_per_year')}, {r('d / q', 'orders_per_year')},
        {r('365 / (d / q)', 'cycle_days')} FROM eoq""",
    ),
)
def m1(spark, folder):
    out = stock.order_quantity(F.col("demand_mean") * 365, 50, 0.25, F.col("unit_cost"))
    return rounded(src.items(spark, folder).select("item_id", *[c.alias(n) for n, c in out.items()]))


TIERS = ((1, 1.0), (500, 0.97), (2000, 0.95), (8000, 0.9))


@query(
    "M2_quantity_discounts",
    with_(
        [
            src.ITEMS,
            "tiers AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, CAST({f} AS DOUBLE))" for q, f in TIERS) + ") t(threshold, factor))",
            """priced AS (SELECT item_id, threshold, unit_cost * factor AS c, demand_mean * 365 AS d,
            greatest(sqrt(2 * demand_mean * 365 * 50 / (CAST(0.25 AS DOUBLE) * unit_cost * factor)), threshold) AS q
            FROM items, tiers),
            totals AS (SELECT *, d * c + d / q * 50 + q / 2 * 0.25 * c AS total FROM priced)""",
        ],
        f"""SELECT item_id, {r('MIN(total)', 'total_cost')},
        {r('arg_min(q, struct_pack(a := total, b := threshold))', 'order_quantity')},
        {r('arg_min(c, struct_pack(a := total, b := threshold))', 'unit_cost')},
        {r('arg_min(CAST(threshold AS DOUBLE), struct_pack(a := total, b := threshold))', 'threshold')} FROM totals GROUP BY 1""",
    ),
)
def m2(spark, folder):
    tiers = F.array(
        *[F.struct(F.lit(q).alias("quantity"), (F.col("unit_cost") * f).alias("unit_cost")) for q, f in TIERS]
    )
    best = stock.cheapest_tier(F.col("demand_mean") * 365, 50, 0.25, tiers)
    df = src.items(spark, folder).select("item_id", best.alias("best"))
    return rounded(df.select("item_id", "best.total_cost", "best.order_quantity", "best.unit_cost", "best.threshold"))


# classes

ABC = """abc AS (
  SELECT *, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (
    SELECT *, SUM(annual_value) OVER (ORDER BY annual_value DESC, item_id ROWS UNBOUNDED PRECEDING)
              / SUM(annual_value) OVER () AS share FROM items))"""


@query("W14_running_share", with_([src.ITEMS, ABC], f"SELECT item_id, {r('annual_value', 'annual_value')}, {r('share', 'cumulative_share', 6)} FROM abc"))
def w14(spark, folder):
    shared = classify.running_share(src.items(spark, folder), "annual_value", "item_id")
    df = shared.select("item_id", F.round("annual_value", 4).alias("annual_value"), "cumulative_share")
    return rounded(df, 6, keep=("annual_value",))


@query("M3_abc_classes", with_([src.ITEMS, ABC], f"SELECT item_id, {r('share', 'cumulative_share', 6)}, abc_class FROM abc"))
def m3(spark, folder):
    df = classify.abc_classes(src.items(spark, folder))
    return rounded(df.select("item_id", "cumulative_share", "abc_class"), 6)


@query(
    "A26_abc_statistics",
    with_(
        [src.ITEMS, ABC],
        f"""SELECT abc_class, COUNT(*) AS item_count, {r('SUM(annual_value)', 'total_value', 2)},
        {r('MAX(share)', 'max_cumulative_share', 2)} FROM abc GROUP BY 1""",
    ),
)
def a26(spark, folder):
    return rounded(classify.abc_statistics(classify.abc_classes(src.items(spark, folder))), 2)


XYZ = """xyz AS (
  SELECT *, CASE WHEN cv <= 0.2 THEN 'X' WHEN cv <= 0.5 THEN 'Y' ELSE 'Z' END AS xyz_class FROM (
    SELECT *, CASE WHEN demand_mean = 0 AND demand_std <> 0 THEN CAST('inf' AS DOUBLE)
              ELSE COALESCE(demand_std / NULLIF(demand_mean, 0), 0) END AS cv FROM items))"""


@query("M4_xyz_classes", with_([src.ITEMS, XYZ], f"SELECT item_id, {r('cv', 'cv')}, xyz_class FROM xyz"))
def m4(spark, folder):
    return rounded(classify.xyz_classes(src.items(spark, folder), "demand_mean").select("item_id", "cv", "xyz_class"))


@query(
    "M4_xyz_default_spread",
    with_(src.ITEMS, "SELECT 'Y' AS xyz_class, COUNT(*) AS items FROM items WHERE demand_mean > 0"),
)
def m4_default(spark, folder):
    df = classify.xyz_classes(src.items(spark, folder).select("item_id", "demand_mean"), "demand_mean")
    return df.groupBy("xyz_class").agg(F.count(F.lit(1)).alias("items"))


@query(
    "A27_xyz_statistics",
    with_(
        [src.ITEMS, XYZ],
        f"""SELECT xyz_class, COUNT(cv) AS cv_count, {r('AVG(cv)', 'cv_mean')}, {r('STDDEV_SAMP(cv)', 'cv_std')},
        {r('AVG(demand_mean)', 'demand_mean')}, {r('SUM(demand_mean)', 'demand_sum')} FROM xyz GROUP BY 1""",
    ),
)
def a27(spark, folder):
    df = classify.xyz_classes(src.items(spark, folder), "demand_mean")
    return rounded(classify.xyz_statistics(df, "demand_mean"))


# item optimisation

RESULTS = f"""base AS (
  SELECT item_id, current_inventory, demand_mean AS demand_forecast, demand_mean * 0.2 AS demand_std,
         CAST(lead_time AS DOUBLE) AS lead, unit_cost FROM items),
stocked AS (
  SELECT *, {ss_sql('demand_forecast', 'demand_std', 'lead', z_sql(0.95))} AS safety_stock,
         COALESCE({eoq_sql('demand_forecast * 365', 50, 0.25, 'unit_cost')}, 0) AS eoq FROM base),
pointed AS (
  SELECT *, CASE WHEN demand_forecast > 0 AND lead > 0 THEN greatest(0, demand_forecast * lead + safety_stock)
                 ELSE safety_stock END AS reorder_point FROM stocked),
results AS (
  SELECT item_id, current_inventory, demand_forecast, demand_std, safety_stock, reorder_point, eoq,
         CASE WHEN current_inventory <= reorder_point THEN eoq ELSE 0 END AS recommended_order,
         demand_forecast * 365 / greatest(current_inventory, 1) AS inventory_turns,
         CAST(0.95 AS DOUBLE) AS service_level,
         COALESCE(demand_forecast * 365 / NULLIF(eoq, 0) * 50 + eoq / 2 * 0.25 * unit_cost, 0) AS total_cost, unit_cost
  FROM pointed)"""
RESULT_OUT = "item_id, " + ", ".join(
    r(c, c)
    for c in (
        "current_inventory", "demand_forecast", "demand_std", "safety_stock", "reorder_point", "eoq",
        "recommended_order", "inventory_turns", "service_level", "total_cost", "unit_cost",
    )
)


def results(spark, folder):
    """Item optimisation of the whole item table."""
    df = src.items(spark, folder)
    return inventory.optimise_stock(
        df.select("item_id", "current_inventory", "unit_cost", "lead_time", F.col("demand_mean").alias("forecast"))
    )


@query("M5_item_optimisation", with_([src.ITEMS, RESULTS], f"SELECT {RESULT_OUT} FROM results"))
def m5(spark, folder):
    return rounded(results(spark, folder))


@query(
    "J5_forecast_with_stock",
    with_(src.ITEMS, f"SELECT item_id, {r('demand_mean', 'forecast')}, current_inventory, CAST(lead_time AS BIGINT) AS lead_time FROM items"),
)
def j5(spark, folder):
    df = src.items(spark, folder)
    forecast = src.item_demand(spark, folder).groupBy("item_id").agg(F.avg("demand").alias("forecast"))
    shelf = df.select("item_id", "current_inventory", "lead_time")
    return rounded(inventory.forecast_with_stock(forecast, shelf))


SERIES_STOCK = """shelf AS (
  SELECT row_number() OVER (ORDER BY store_nbr, family) - 1 AS item_id, store_nbr, family
  FROM (SELECT DISTINCT store_nbr, family FROM panel))"""


@query(
    "J7_item_numbers",
    with_([src.PANEL, SERIES_STOCK], f"SELECT {b('item_id', 'item_id')}, {b('store_nbr', 'store_nbr')}, family FROM shelf"),
)
def j7(spark, folder):
    return rounded(classify.number_items(src.panel(spark, folder), ["store_nbr", "family"]))


@query(
    "J6_forecast_by_series_keys",
    with_(
        [src.PANEL, src.FUTURE, src.FORECASTS, SERIES_STOCK],
        f"""SELECT {b('s.item_id', 'item_id')}, {b('s.store_nbr', 'store_nbr')}, s.family,
        {r('AVG(forecast)', 'forecast')} FROM forecasts f
        JOIN shelf s ON f.store_nbr = s.store_nbr AND f.family = s.family GROUP BY s.item_id, s.store_nbr, s.family""",
    ),
)
def j6(spark, folder):
    shelf = classify.number_items(src.panel(spark, folder), ["store_nbr", "family"])
    per_item = inventory.forecast_per_item(src.forecasts(spark, folder), ["store_nbr", "family"])
    return rounded(inventory.forecast_with_stock(per_item, shelf, ["store_nbr", "family"]))


@query(
    "A29_optimisation_totals",
    with_(
        [src.ITEMS, RESULTS],
        f"""SELECT COUNT(*) AS total_items, {r('SUM(recommended_order)', 'recommended_units', 2)},
        {r('SUM(current_inventory * unit_cost)', 'inventory_value', 2)}, {r('AVG(inventory_turns)', 'mean_turns', 2)},
        COUNT(*) FILTER (recommended_order > 0) AS items_to_reorder FROM results""",
    ),
)
def a29(spark, folder):
    return rounded(inventory.optimisation_totals(results(spark, folder)), 2)


PLAN_COST = "greatest(0, safety_stock + reorder_point)"


@query(
    "M6_order_plan",
    with_(
        [src.ITEMS, RESULTS],
        f"""SELECT item_id, 'optimal' AS status, {r(PLAN_COST, 'optimal_order_quantity')},
        {r(f'{PLAN_COST} * (unit_cost + 0.25 / 2)', 'order_cost')} FROM results""",
    ),
)
def m6(spark, folder):
    plan = inventory.order_plan(results(spark, folder), budget=None, storage=None)
    return rounded(plan.select("item_id", "status", "optimal_order_quantity", "order_cost"))


@query(
    "M6_order_plan_totals",
    with_(
        [src.ITEMS, RESULTS],
        f"""SELECT CASE WHEN ok THEN 'optimal' ELSE 'infeasible' END AS status, items,
        CASE WHEN ok THEN round(q, 2) END AS total_quantity, CASE WHEN ok THEN round(c, 2) END AS optimal_total_cost FROM (
        SELECT COUNT(*) AS items, SUM({PLAN_COST}) AS q, SUM({PLAN_COST} * (unit_cost + 0.25 / 2)) AS c,
        SUM({PLAN_COST} * unit_cost) <= 1000000 AND SUM({PLAN_COST}) <= 10000 AS ok FROM results)""",
    ),
)
def m6_totals(spark, folder):
    return rounded(inventory.order_plan_totals(inventory.order_plan(results(spark, folder))), 2)


RECS = """recs AS (
  SELECT *, CASE priority WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS priority_rank,
         CASE priority WHEN 'Critical' THEN 'Emergency Order' WHEN 'High' THEN 'Place Order' WHEN 'Low' THEN 'Reduce Stock'
                       ELSE 'Monitor' END AS action,
         CASE priority WHEN 'Critical' THEN 'Below safety stock' WHEN 'High' THEN 'Below reorder point'
                       WHEN 'Low' THEN 'Low inventory turnover' ELSE 'Normal inventory levels' END AS reason FROM (
    SELECT *, CASE WHEN current_inventory <= safety_stock THEN 'Critical' WHEN current_inventory <= reorder_point THEN 'High'
                   WHEN inventory_turns < 4 THEN 'Low' ELSE 'Medium' END AS priority FROM results))"""


def recommendations(spark, folder):
    return inventory.recommend(results(spark, folder))


@query(
    "M7_recommendations",
    with_(
        [src.ITEMS, RESULTS, RECS],
        f"""SELECT item_id, {r('current_inventory', 'current_inventory')}, {r('reorder_point', 'reorder_point')},
        {r('recommended_order', 'recommended_order')}, priority, action, reason, {b('priority_rank', 'priority_rank')} FROM recs""",
    ),
)
def m7(spark, folder):
    df = inventory.by_priority(recommendations(spark, folder))
    return rounded(
        df.select("item_id", "current_inventory", "reorder_point", "recommended_order", "priority", "action", "reason",
                  "priority_rank")
    )


@query(
    "T3_priority_order",
    with_(
        [src.ITEMS, RESULTS, RECS],
        f"SELECT item_id, priority, {r('recommended_order', 'recommended_order')} FROM recs ORDER BY priority_rank, item_id",
    ),
)
def t3(spark, folder):
    df = inventory.by_priority(recommendations(spark, folder))
    return rounded(df.select("item_id", "priority", "recommended_order"))


# scenarios


def scenario_sql(m, s, lead, z, k, h, c):
    stock_ = f"greatest(0, {z} * {s} * sqrt({lead}))"
    q = f"sqrt(greatest(1, 2 * (365 * {m}) * {k} / ({h} * {c})))"
    holding = f"(({q} / 2 + {stock_}) * {c} * {h})"
    ordering = f"(365 * {m} / {q} * {k})"
    return {
        "safety_stock": stock_, "eoq": q, "reorder_point": f"({m} * {lead} + {stock_})", "holding_cost": holding,
        "order_cost_yr": ordering, "total_cost": f"({holding} + {ordering})",
    }


BASE_SQL = scenario_sql("demand_mean", "demand_std", "lead_time", z_sql(0.95), "CAST(50 AS DOUBLE)", dbl(0.25), "unit_cost")
NEW_SQL = scenario_sql("demand_mean", "demand_std", "lead_time", z_sql(0.99), "CAST(80 AS DOUBLE)", dbl(0.3), "unit_cost")


def _scenario(level=0.95, k=50, h=0.25):
    return stock.scenario(
        F.col("demand_mean"), F.col("demand_std"), F.col("lead_time").cast("double"), level, k, h, F.col("unit_cost")
    )


@query("M8_scenario", with_(src.ITEMS, "SELECT item_id, " + ", ".join(r(e, n) for n, e in BASE_SQL.items()) + " FROM items"))
def m8(spark, folder):
    return rounded(src.items(spark, folder).select("item_id", *[c.alias(n) for n, c in _scenario().items()]))


@query(
    "M22_scenario_against_base",
    with_(
        src.ITEMS,
        "SELECT item_id, "
        + ", ".join(r(f"100 * ({NEW_SQL[n]} - {e}) / NULLIF({e}, 0)", f"{n}_change") for n, e in BASE_SQL.items())
        + " FROM items",
    ),
)
def m22(spark, folder):
    change = inventory.compare_scenarios(_scenario(), _scenario(0.99, 80, 0.3))
    return rounded(src.items(spark, folder).select("item_id", *[c.alias(f"{n}_change") for n, c in change.items()]))


@query(
    "M22_baseline",
    with_(
        src.ITEMS,
        f"""SELECT {r('AVG(current_inventory) * 0.3', 'demand_mean')}, {r('AVG(current_inventory) * 0.3 * 0.25', 'demand_std')},
        {r('AVG(unit_cost)', 'unit_cost')} FROM items""",
    ),
)
def m22_base(spark, folder):
    return rounded(inventory.scenario_baseline(src.items(spark, folder)))


LEVELS = stock.service_level_grid(0.85, 0.99, 0.01)
SWEEP_SQL = scenario_sql("demand_mean", "demand_std", "lead_time", "z", "CAST(50 AS DOUBLE)", dbl(0.25), "unit_cost")


@query(
    "M23_level_sweep",
    with_(
        [
            src.ITEMS,
            "levels AS (SELECT * FROM (VALUES " + ", ".join(f"({dbl(p)}, {z_sql(p)})" for p in LEVELS) + ") t(service_level, z))",
        ],
        f"""SELECT item_id, service_level, {r(SWEEP_SQL['safety_stock'], 'safety_stock')},
        {r(SWEEP_SQL['total_cost'], 'total_cost')} FROM items, levels""",
    ),
)
def m23(spark, folder):
    swept = inventory.level_sweep(
        src.items(spark, folder), LEVELS, F.col("demand_mean"), F.col("demand_std"), F.col("lead_time").cast("double"),
        50, 0.25, F.col("unit_cost"),
    )
    return rounded(swept)


COSTS = [10 + 240 * i / 39 for i in range(40)]
COST_SQL = scenario_sql("demand_mean", "demand_std", "lead_time", z_sql(0.95), "k", dbl(0.25), "unit_cost")


@query(
    "M24_ordering_cost_sweep",
    with_(
        [src.ITEMS, "costs AS (SELECT * FROM (VALUES " + ", ".join(f"({dbl(c)})" for c in COSTS) + ") t(k))"],
        f"""SELECT item_id, {r('k', 'ordering_cost')}, {r(COST_SQL['holding_cost'], 'holding_cost')},
        {r(COST_SQL['order_cost_yr'], 'order_cost_yr')}, {r(COST_SQL['total_cost'], 'total_cost')} FROM items, costs""",
    ),
)
def m24(spark, folder):
    swept = inventory.ordering_cost_sweep(
        src.items(spark, folder), COSTS, F.col("demand_mean"), F.col("demand_std"), F.col("lead_time").cast("double"),
        0.95, 0.25, F.col("unit_cost"),
    )
    return rounded(swept)


HEALTH = """CASE WHEN current_inventory <= safety_stock THEN greatest(0, current_inventory / greatest(safety_stock, 1) * 20)
  WHEN current_inventory <= reorder_point
    THEN 20 + (current_inventory - safety_stock) / greatest(reorder_point - safety_stock, 1) * 30
  ELSE least(100, 50 + (current_inventory - reorder_point) / greatest(reorder_point, 1) * 50) END"""


@query("M9_stock_health", with_([src.ITEMS, RESULTS], f"SELECT item_id, {r(HEALTH, 'stock_health')} FROM results"))
def m9(spark, folder):
    health = stock.stock_health(F.col("current_inventory"), F.col("reorder_point"), F.col("safety_stock"))
    return rounded(results(spark, folder).select("item_id", health.alias("stock_health")))


# safety stock

M, S, L = "demand_mean", "demand_std", "CAST(lead_time AS DOUBLE)"


def _item(spark, folder, column, name="safety_stock"):
    return rounded(src.items(spark, folder).select("item_id", column.alias(name)))


def _args():
    return F.col("demand_mean"), F.col("demand_std"), F.col("lead_time").cast("double")


@query("M10_safety_stock", with_(src.ITEMS, f"SELECT item_id, {r(ss_sql(M, S, L, z_sql(0.95)), 'safety_stock')} FROM items"))
def m10(spark, folder):
    return _item(spark, folder, stock.safety_stock(*_args(), 0.95))


@query(
    "M10_safety_stock_row_level",
    with_(
        src.ITEMS,
        f"""SELECT item_id, {r(ss_sql(M, S, L, f"CASE family WHEN 'PROMO' THEN {z_sql(0.99)} WHEN 'SMALL' THEN {z_sql(0.90)} ELSE {z_sql(0.95)} END"), 'safety_stock')}
        FROM items""",
    ),
)
def m10_level(spark, folder):
    level = F.when(F.col("family") == "PROMO", 0.99).when(F.col("family") == "SMALL", 0.90).otherwise(0.95)
    return _item(spark, folder, stock.safety_stock(*_args(), level))


@query(
    "M11_variable_lead_time",
    with_(
        src.ITEMS,
        f"""SELECT item_id, {r(f'greatest(0, {z_sql(0.95)} * sqrt({L} * {S} * {S} + {M} * {M} * ({L} * 0.2) * ({L} * 0.2)))', 'safety_stock')}
        FROM items""",
    ),
)
def m11(spark, folder):
    m, s, lead = _args()
    return _item(spark, folder, stock.safety_stock_variable_lead(m, s, lead, lead * 0.2))


@query(
    "M12_periodic_review",
    with_(src.ITEMS, f"SELECT item_id, {r(f'greatest(0, {z_sql(0.95)} * {S} * sqrt({L} + 7))', 'safety_stock')} FROM items"),
)
def m12(spark, folder):
    return _item(spark, folder, stock.safety_stock_periodic(*_args(), 7))


@query(
    "M13_seasonal_safety_stock",
    with_(
        [
            src.PANEL,
            """placed AS (SELECT store_nbr, family, sales, row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) - 1 AS i,
            COUNT(*) OVER (PARTITION BY store_nbr, family) AS n FROM panel),
            g AS (SELECT store_nbr, family, CASE WHEN n < 2 * 182 THEN -1 ELSE i % 182 END AS period, AVG(sales) AS m,
            STDDEV_POP(sales) AS sp, COALESCE(STDDEV_SAMP(sales), 0) AS ss FROM placed GROUP BY 1, 2, 3)""",
        ],
        f"""SELECT {b('store_nbr', 'store_nbr')}, family, {b('period', 'period')}, {r('m', 'demand_mean')},
        {r('CASE WHEN period = -1 THEN ss ELSE sp END', 'demand_std')},
        {r(ss_sql('m', '(CASE WHEN period = -1 THEN ss ELSE sp END)', '14', z_sql(0.95)), 'safety_stock')} FROM g""",
    ),
)
def m13(spark, folder):
    return rounded(
        inventory.seasonal_safety_stock(
            src.panel(spark, folder), ["store_nbr", "family"], "date", "sales", 14, 0.95, season=182
        )
    )


CLASS_Z = f"CASE abc_class WHEN 'A' THEN {z_sql(0.99)} WHEN 'B' THEN {z_sql(0.95)} WHEN 'C' THEN {z_sql(0.90)} END"


@query("M14_safety_stock_by_class", with_([src.ITEMS, ABC], f"SELECT item_id, abc_class, {r(ss_sql(M, S, L, f'({CLASS_Z})'), 'safety_stock')} FROM abc"))
def m14(spark, folder):
    df = classify.abc_classes(src.items(spark, folder))
    column = stock.safety_stock_by_class(*_args(), F.col("abc_class"))
    return rounded(df.select("item_id", "abc_class", column.alias("safety_stock")))


GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({dbl(p)}, {z_sql(p)})" for p in stock.service_level_grid()
) + ") t(p, z))"
BEST = f"""costs AS (
  SELECT item_id, p, {ss_sql(M, S, L, 'z')} AS ss, {ss_sql(M, S, L, 'z')} * unit_cost * 0.25
         + (1 - p) * (unit_cost * 5) * (365 / {L}) AS total FROM items, grid),
best AS (
  SELECT item_id, MIN(total) AS total_cost, arg_min(p, struct_pack(a := total, b := p)) AS service_level,
         arg_min(ss, struct_pack(a := total, b := p)) AS safety_stock FROM costs GROUP BY 1)"""


def _costs():
    return stock.level_costs(*_args(), 0.25, F.col("unit_cost") * 5, F.col("unit_cost"))


@query(
    "M15_cheapest_service_level",
    with_([src.ITEMS, GRID, BEST],
          f"SELECT item_id, {r('total_cost', 'total_cost')}, service_level, {r('safety_stock', 'safety_stock')} FROM best"),
)
def m15(spark, folder):
    df = src.items(spark, folder).select("item_id", F.array_min(_costs()).alias("b"))
    return rounded(df.select("item_id", "b.total_cost", "b.service_level", "b.safety_stock"))


@query(
    "M15_cost_breakdown",
    with_(
        [src.ITEMS, GRID, BEST],
        f"""SELECT p AS service_level, COUNT(*) AS items, {r('AVG(ss)', 'mean_safety_stock')},
        {r('AVG(total)', 'mean_total_cost')} FROM costs GROUP BY 1""",
    ),
)
def m15_breakdown(spark, folder):
    df = src.items(spark, folder).select("item_id", F.explode(_costs()).alias("b"))
    return rounded(
        df.groupBy("b.service_level").agg(
            F.count(F.lit(1)).alias("items"),
            F.avg("b.safety_stock").alias("mean_safety_stock"),
            F.avg("b.total_cost").alias("mean_total_cost"),
        )
    )


@query(
    "M16_shortage_ordering",
    with_(src.ITEMS, f"SELECT item_id, {r(ss_sql(f'({M} * 1.2)', f'({S} * 1.2)', L, z_sql(0.99)), 'safety_stock')} FROM items"),
)
def m16(spark, folder):
    return _item(spark, folder, stock.safety_stock_shortage(*_args()))


RECENT = "OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
DYNAMIC = f"""errors AS (SELECT *, predicted - actual AS error FROM predictions),
spread AS (
  SELECT *, CASE WHEN COUNT(*) {RECENT} = 0 THEN 0 WHEN COUNT(*) {RECENT} = 1 THEN MAX(ABS(error)) {RECENT}
            ELSE STDDEV_POP(error) {RECENT} END AS error_std FROM errors),
lev AS (
  SELECT *, CASE WHEN error_std / greatest(predicted, 1) < CAST(0.1 AS DOUBLE) THEN CAST(0.90 AS DOUBLE)
                 WHEN error_std / greatest(predicted, 1) < CAST(0.2 AS DOUBLE) THEN CAST(0.95 AS DOUBLE)
                 ELSE CAST(0.99 AS DOUBLE) END AS service_level FROM spread)"""


def dynamic(spark, folder):
    errors = src.predictions(spark, folder).withColumn("error", F.col("predicted") - F.col("actual"))
    return inventory.dynamic_safety_stock(errors, ["store_nbr", "family"], "date", 14, "predicted")


@query(
    "W17_error_spread",
    with_([src.PANEL, src.PREDICTIONS, DYNAMIC],
          f"SELECT date, {b('store_nbr', 'store_nbr')}, family, {r('error_std', 'error_std')} FROM spread"),
)
def w17(spark, folder):
    return rounded(dynamic(spark, folder).select("date", "store_nbr", "family", "error_std"))


@query(
    "M17_dynamic_safety_stock",
    with_(
        [src.PANEL, src.PREDICTIONS, DYNAMIC],
        f"""SELECT date, {b('store_nbr', 'store_nbr')}, family, service_level,
        {r(ss_sql('predicted', 'error_std', '14', f"(CASE service_level WHEN CAST(0.90 AS DOUBLE) THEN {z_sql(0.90)} WHEN CAST(0.95 AS DOUBLE) THEN {z_sql(0.95)} ELSE {z_sql(0.99)} END)"), 'safety_stock')}
        FROM lev""",
    ),
)
def m17(spark, folder):
    return rounded(dynamic(spark, folder).select("date", "store_nbr", "family", "service_level", "safety_stock"))


REPORT = f"""report AS (
  SELECT i.item_id, {ss_sql('i.' + M, 'i.' + S, 'CAST(i.lead_time AS DOUBLE)', z_sql(0.95))} AS basic_safety_stock,
         {ss_sql('i.' + M, 'i.' + S, 'CAST(i.lead_time AS DOUBLE)', f'({CLASS_Z})')} AS abc_safety_stock,
         b.safety_stock AS optimal_safety_stock, b.safety_stock * i.unit_cost AS safety_stock_value
  FROM abc i JOIN best b ON i.item_id = b.item_id)"""


def stock_report(spark, folder):
    df = classify.abc_classes(src.items(spark, folder)).withColumns(
        {"holding_cost_rate": F.lit(0.25), "stockout_cost": F.col("unit_cost") * 5}
    )
    return inventory.safety_stock_report(df)


@query(
    "M18_stock_report",
    with_(
        [src.ITEMS, ABC, GRID, BEST, REPORT],
        f"""SELECT item_id, {r('basic_safety_stock', 'basic_safety_stock')}, {r('abc_safety_stock', 'abc_safety_stock')},
        {r('optimal_safety_stock', 'optimal_safety_stock')}, {r('basic_safety_stock', 'current_safety_stock')},
        {r('safety_stock_value', 'safety_stock_value')}, CAST(0.95 AS DOUBLE) AS service_level FROM report""",
    ),
)
def m18(spark, folder):
    return rounded(stock_report(spark, folder))


@query(
    "M18_report_summary",
    with_(
        [src.ITEMS, ABC, GRID, BEST, REPORT],
        f"""SELECT COUNT(*) AS total_items, {r('SUM(safety_stock_value)', 'total_safety_stock_value', 2)},
        {r('AVG(optimal_safety_stock)', 'average_safety_stock', 2)}, {r('MIN(optimal_safety_stock)', 'min_safety_stock', 2)},
        {r('MAX(optimal_safety_stock)', 'max_safety_stock', 2)} FROM report""",
    ),
)
def m18_summary(spark, folder):
    return rounded(inventory.safety_stock_summary(stock_report(spark, folder)), 2)


@query(
    "M18_report_alerts",
    with_(
        [src.ITEMS, ABC, GRID, BEST, REPORT,
         "limits AS (SELECT quantile_cont(optimal_safety_stock, 0.9) AS q9, quantile_cont(safety_stock_value, 0.8) AS q8 FROM report)"],
        """SELECT item_id, 'high_safety_stock' AS alert FROM report, limits WHERE optimal_safety_stock > q9
        UNION ALL SELECT item_id, 'high_value_safety_stock' FROM report, limits WHERE safety_stock_value > q8""",
    ),
)
def m18_alerts(spark, folder):
    from shelfcast.plans.durable import durable

    return inventory.safety_stock_alerts(durable(stock_report(spark, folder))).select("item_id", "alert")


@query(
    "M19_reorder_point",
    with_([src.ITEMS, RESULTS], f"SELECT item_id, {r('demand_mean * lead_time + 0.5 * demand_std', 'reorder_point')} FROM items"),
)
def m19(spark, folder):
    m, s, lead = _args()
    return _item(spark, folder, stock.reorder_point(m, lead, s * 0.5), "reorder_point")


@query(
    "M20_dynamic_reorder_point",
    with_(
        [
            src.PANEL, src.FUTURE, src.FORECASTS,
            """n AS (SELECT store_nbr, family, forecast, row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) AS i FROM forecasts),
            s AS (SELECT store_nbr, family, SUM(forecast) AS t, AVG(forecast) AS m, COUNT(*) AS c FROM n WHERE i <= 45 GROUP BY 1, 2)""",
        ],
        f"""SELECT {b('store_nbr', 'store_nbr')}, family, {r('t + m * greatest(45.5 - c, 0)', 'lead_time_demand')},
        {r('greatest(0, t + m * greatest(45.5 - c, 0) + 25)', 'reorder_point')} FROM s""",
    ),
)
def m20(spark, folder):
    return rounded(
        inventory.dynamic_reorder_point(src.forecasts(spark, folder), ["store_nbr", "family"], "date", 45.5, 25.0)
    )


@query(
    "M20_dynamic_reorder_point_short_lead",
    with_(
        [
            src.PANEL, src.FUTURE, src.FORECASTS,
            """n AS (SELECT store_nbr, family, forecast, row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) AS i FROM forecasts),
            s AS (SELECT store_nbr, family, SUM(forecast) AS t FROM n WHERE i <= 14 GROUP BY 1, 2)""",
        ],
        f"SELECT {b('store_nbr', 'store_nbr')}, family, {r('t', 'lead_time_demand')}, {r('greatest(0, t + 25)', 'reorder_point')} FROM s",
    ),
)
def m20_short(spark, folder):
    return rounded(inventory.dynamic_reorder_point(src.forecasts(spark, folder), ["store_nbr", "family"], "date", 14, 25.0))


@query("M21_annual_value", with_([src.ITEMS, RESULTS], f"SELECT item_id, {r('demand_forecast * 365 * 10', 'annual_value')} FROM results"))
def m21(spark, folder):
    return rounded(inventory.annual_value(results(spark, folder)).select("item_id", "annual_value"))


@query(
    "M26_stock_defaults",
    with_([src.ITEMS, RESULTS], f"SELECT item_id, {r('reorder_point * 0.35', 'safety_stock')}, CAST(14 AS BIGINT) AS lead_time FROM results"),
)
def m26(spark, folder):
    bare = results(spark, folder).select("item_id", "reorder_point")
    return rounded(inventory.with_stock_defaults(bare).select("item_id", "safety_stock", "lead_time"))


STAGE = """valued AS (SELECT *, demand_forecast * 365 * 10 AS annual_value FROM recs),
staged AS (
  SELECT *, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (
    SELECT *, SUM(annual_value) OVER (ORDER BY annual_value DESC, item_id ROWS UNBOUNDED PRECEDING)
              / SUM(annual_value) OVER () AS share FROM valued))"""


@query(
    "M25_optimisation_stage",
    with_(
        [src.ITEMS, RESULTS, RECS, STAGE],
        f"""SELECT item_id, {r('safety_stock', 'safety_stock')}, {r('reorder_point', 'reorder_point')}, {r('eoq', 'eoq')},
        {r('annual_value', 'annual_value', 2)}, abc_class, priority, action FROM staged""",
    ),
)
def m25(spark, folder):
    from shelfcast.plans.inventory import stock_decisions

    df = src.items(spark, folder).withColumnRenamed("demand_mean", "forecast")
    staged = stock_decisions(df.select("item_id", "forecast", "current_inventory", "unit_cost", "lead_time"))
    return rounded(
        staged.select(
            "item_id", "safety_stock", "reorder_point", "eoq", F.round("annual_value", 2).alias("annual_value"),
            "abc_class", "priority", "action",
        ),
        keep=("annual_value",),
    )


@query(
    "A28_inventory_kpis",
    with_(
        [src.ITEMS, ABC],
        f"""SELECT COUNT(*) AS items, {r('SUM(demand_mean * 365) / greatest(SUM(current_inventory), 1)', 'inventory_turnover')},
        {r('(SUM(demand_days) - SUM(CASE WHEN current_inventory < demand_mean THEN 1 ELSE 0 END)) / greatest(SUM(demand_days), 1)', 'fill_rate')},
        {r('SUM(current_inventory * unit_cost) * 0.25', 'carrying_cost')},
        {', '.join(r(f"100.0 * COUNT(*) FILTER (abc_class = '{c}') / COUNT(*)", f'{c.lower()}_percent') for c in 'ABC')}
        FROM abc""",
    ),
)
def a28(spark, folder):
    df = classify.abc_classes(src.items(spark, folder)).select(
        (F.col("demand_mean") * 365).alias("annual_demand"),
        F.col("current_inventory").alias("average_inventory"),
        (F.col("current_inventory") < F.col("demand_mean")).cast("int").alias("stockouts"),
        F.col("demand_days").alias("total_orders"),
        (F.col("current_inventory") * F.col("unit_cost")).alias("inventory_value"),
        "abc_class",
    )
    return rounded(inventory.inventory_kpis(df))


# the flagship: from sales lines to decisions per series

FLAGSHIP = f"""hist AS (
  SELECT store_nbr, family, AVG(predicted) AS forecast, STDDEV_SAMP(actual) AS forecast_std, AVG(actual) AS level
  FROM predictions GROUP BY 1, 2),
base0 AS (SELECT item_id, forecast, forecast_std, CAST(item_id * 53 % 900 AS DOUBLE) AS current_inventory
  FROM hist JOIN shelf USING (store_nbr, family)),
fl1 AS (SELECT *, {ss_sql('forecast', 'forecast_std', '14', z_sql(0.95))} AS safety_stock,
  {eoq_sql('forecast * 365', 50, 0.25, '1')} AS eoq FROM base0),
fl2 AS (SELECT *, forecast * 14 + safety_stock AS reorder_point, forecast * 365 / greatest(current_inventory, 1) AS turns,
  forecast * 365 * 10 AS annual_value FROM fl1),
fl3 AS (SELECT *, SUM(annual_value) OVER (ORDER BY annual_value DESC, item_id ROWS UNBOUNDED PRECEDING)
  / SUM(annual_value) OVER () AS share FROM fl2)"""


@query(
    "flagship_stock_decisions",
    with_(
        [src.PANEL, src.PREDICTIONS, SERIES_STOCK, FLAGSHIP],
        f"""SELECT {ITEM_KEY}, {r('forecast', 'demand_forecast')}, {r('safety_stock', 'safety_stock')},
        {r('reorder_point', 'reorder_point')}, {r('eoq', 'eoq')},
        CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class,
        CASE WHEN current_inventory <= safety_stock THEN 'Critical' WHEN current_inventory <= reorder_point THEN 'High'
             WHEN turns < 4 THEN 'Low' ELSE 'Medium' END AS priority FROM fl3""",
    ),
)
def flagship(spark, folder):
    from shelfcast.plans.durable import durable
    from shelfcast.plans.inventory import stock_decisions

    pairs = durable(src.predictions(spark, folder))
    per_series = pairs.groupBy("store_nbr", "family").agg(
        F.avg("predicted").alias("forecast"), F.stddev_samp("actual").alias("forecast_std")
    )
    shelf = classify.number_items(pairs, ["store_nbr", "family"])
    items = per_series.join(shelf, ["store_nbr", "family"]).withColumn(
        "current_inventory", (F.col("item_id") * 53 % 900).cast("double")
    )
    decided = stock_decisions(items)
    return rounded(
        decided.select("item_id", "demand_forecast", "safety_stock", "reorder_point", "eoq", "abc_class", "priority")
    )


STAGE_ITEMS = """items AS (
  SELECT s.item_id, CAST(s.item_id * 37 % 1400 AS DOUBLE) AS current_inventory, CAST(5 + s.item_id % 20 AS DOUBLE) AS unit_cost,
         CAST(s.item_id % 21 + 7 AS INTEGER) AS lead_time, AVG(forecast) AS demand_mean
  FROM forecasts f JOIN shelf s ON f.store_nbr = s.store_nbr AND f.family = s.family GROUP BY s.item_id)"""


@query(
    "M25_stage_end_to_end",
    with_(
        [src.PANEL, src.FUTURE, src.FORECASTS, SERIES_STOCK, STAGE_ITEMS, RESULTS, RECS, STAGE],
        f"""SELECT {b('item_id', 'item_id')}, {r('safety_stock', 'safety_stock')}, {r('reorder_point', 'reorder_point')},
        {r('eoq', 'eoq')}, abc_class, priority, action FROM staged""",
    ),
)
def m25_stage(spark, folder):
    """Numbered items with their stock, joined to the forecasts of their series, decided, written and read back."""
    from shelfcast.catalog.tables import scratch
    from shelfcast.plans.inventory import stock_stage
    from shelfcast.sources import tables as io

    shelf = classify.number_items(src.panel(spark, folder), ["store_nbr", "family"])
    item = F.col("item_id")
    stock = shelf.withColumns(
        {
            "current_inventory": (item * 37 % 1400).cast("double"),
            "unit_cost": (item % 20 + 5).cast("double"),
            "lead_time": (item % 21 + 7).cast("int"),
        }
    )
    decided = stock_stage(src.forecasts(spark, folder), stock)
    path = io.write_outputs({"recommendations": decided}, scratch(spark, "stage"))["recommendations"]
    kept = spark.read.parquet(path)
    return rounded(kept.select("item_id", "safety_stock", "reorder_point", "eoq", "abc_class", "priority", "action"))
