import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import stats, stock
from shelfcast.operators import classify, inventory


@pytest.fixture
def value(spark):
    def get(c):
        return spark.range(1).select(c.alias("x")).first().x

    return get


def test_safety_stock(value):
    assert value(stock.safety_stock(100, 20, 14, 0.95)) == pytest.approx(NormalDist().inv_cdf(0.95) * 20 * math.sqrt(14))
    assert value(stock.safety_stock(100, 20, 14, 0.99)) > value(stock.safety_stock(100, 20, 14, 0.90)) > 0
    for bad in ((0, 20, 14), (100, -1, 14), (100, 20, 0)):
        assert value(stock.safety_stock(*bad)) == 0
    assert value(stock.safety_stock(F.lit(None).cast("double"), 20, 14)) == 0
    assert value(stock.safety_stock(100, 20, 14, 0.3)) == 0  # negative z


def test_other_safety_stocks(value):
    z = NormalDist().inv_cdf(0.95)
    assert value(stock.safety_stock_variable_lead(10, 3, 9, 2)) == pytest.approx(z * math.sqrt(9 * 9 + 100 * 4))
    assert value(stock.safety_stock_periodic(10, 3, 9, 7)) == pytest.approx(z * 3 * 4)
    assert value(stock.safety_stock_shortage(10, 3, 9)) == pytest.approx(NormalDist().inv_cdf(0.99) * 3.6 * 3)
    assert value(stock.safety_stock_by_class(10, 3, 9, F.lit("?"))) == pytest.approx(z * 9)
    assert value(stock.safety_stock_by_class(10, 3, 9, F.lit("A"))) > value(stock.safety_stock_by_class(10, 3, 9, F.lit("C")))


def test_reorder_point(value):
    assert value(stock.reorder_point(10, 14, 50)) == 190
    assert value(stock.reorder_point(50, 14, 20)) > value(stock.reorder_point(10, 14, 20)) > 20
    assert value(stock.reorder_point(0, 14, 20)) == 20


def test_order_quantity(value):
    out = {k: value(c) for k, c in stock.order_quantity(1000, 50, 0.25, 10).items()}
    assert out["eoq"] == pytest.approx(200)
    assert out["ordering_cost_per_year"] == out["holding_cost_per_year"] == pytest.approx(250)
    assert out["cycle_days"] == pytest.approx(73)
    assert all(value(c) is None for c in stock.order_quantity(1000, 50, 0.25, 0).values())


def test_discount_tie_takes_the_smaller_threshold(spark):
    tiers = F.array(
        *[F.struct(F.lit(q).alias("quantity"), F.lit(c).alias("unit_cost")) for q, c in ((150, 10.0), (1, 10.0), (5000, 9.9))]
    )
    best = spark.range(1).select(stock.cheapest_tier(1000, 50, 0.25, tiers).alias("b")).first().b
    assert (best.threshold, best.order_quantity) == (1.0, pytest.approx(200))
    none = spark.range(1).select(stock.cheapest_tier(0, 50, 0.25, tiers).alias("b")).first().b
    assert none is None


def test_level_costs(spark):
    costs = spark.range(1).select(stock.level_costs(10, 3, 14, 0.25, 100, 5).alias("c")).first().c
    assert len(costs) == 50 and costs[0].service_level == 0.5 and costs[-1].service_level == 0.99
    best = min(costs, key=lambda c: c.total_cost)
    got = spark.range(1).select(F.array_min(stock.level_costs(10, 3, 14, 0.25, 100, 5)).alias("b")).first().b
    assert got.service_level == best.service_level


def test_stock_health(value):
    assert value(stock.stock_health(0, 100, 40)) == 0
    assert value(stock.stock_health(40, 100, 40)) == 20
    assert value(stock.stock_health(100, 100, 40)) == 50
    assert value(stock.stock_health(1000, 100, 40)) == 100
    assert value(stock.stock_health(0, 0, 0)) == 0


def test_normal_quantile(spark):
    levels = [1e-12, 1e-5, 0.01, 0.02425, 0.3, 0.5, 0.925, 0.9251, 0.95, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in levels], "p double").select("p", stats.normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-13)
    edges = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(stats.normal_quantile(F.col("p")))
    assert [r[0] for r in edges.collect()] == [None] * 3


def _integral(f, a, b, n=20000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def test_p_values(value):
    density = lambda x: x**4 * math.exp(-x / 2) / (2**5 * math.gamma(5))
    assert value(stats.chi_square_tail(F.lit(12.0), 10)) == pytest.approx(1 - _integral(density, 0, 12), abs=1e-8)
    r, n = 0.3, 25
    t = r * math.sqrt((n - 2) / (1 - r * r))
    c = math.gamma((n - 1) / 2) / (math.sqrt((n - 2) * math.pi) * math.gamma((n - 2) / 2))
    two_sided = 1 - 2 * _integral(lambda x: c * (1 + x * x / (n - 2)) ** (-(n - 1) / 2), 0, t)
    assert stats.correlation_p_value(r, n) == pytest.approx(two_sided, abs=1e-8)
    assert stats.correlation_p_value(1.0, 10) == 0 and math.isnan(stats.correlation_p_value(0.5, 2))
    assert stats.correlation_p_value(0.001, 10_000_000) == pytest.approx(math.erfc(0.001 * math.sqrt(1e7) / math.sqrt(2)), rel=1e-3)


@pytest.mark.parametrize(
    "values, classes",
    [
        ((1000, 500, 100, 50, 10), None),
        ((1000, 900, 800, 100, 50, 40, 30, 20, 10, 5), None),
        ((900, 50, 50), "BBC"),
        ((40, 40, 10, 10), "AABC"),
    ],
)
def test_abc(spark, values, classes):
    items = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "item_id long, annual_value double")
    rows = {r.item_id: r for r in classify.abc_classes(items).collect()}
    got = "".join(rows[i].abc_class for i in range(len(values)))
    assert set(got) <= set("ABC") and got == "".join(sorted(got))
    if classes:
        assert got == classes


def test_xyz(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 10.0, 2.0), (4, 10.0, 4.0), (5, 10.0, 9.0)],
                               "item_id long, demand double, demand_std double")
    assert "".join(r.xyz_class for r in classify.xyz_classes(df).orderBy("item_id").collect()) == "XZXYZ"


def _results(spark, rows):
    return spark.createDataFrame(
        rows, "item_id long, current_inventory double, safety_stock double, reorder_point double, inventory_turns double"
    )


def test_recommendations(spark):
    out = inventory.recommend(
        _results(spark, [(1, 5.0, 5.0, 9.0, 1.0), (2, 9.0, 5.0, 9.0, 1.0), (3, 10.0, 5.0, 9.0, 3.9), (4, 10.0, 5.0, 9.0, 4.0)])
    )
    assert [r.priority for r in out.orderBy("item_id").collect()] == ["Critical", "High", "Low", "Medium"]
    assert [r.item_id for r in inventory.by_priority(out).collect()] == [1, 2, 4, 3]


def test_order_plan(spark):
    items = spark.createDataFrame([(1, 2.0, 10.0, 5.0), (2, 4.0, 1.0, -9.0)],
                                  "item_id long, unit_cost double, safety_stock double, reorder_point double")
    plan = inventory.order_plan(items).orderBy("item_id").collect()
    assert [(r.status, r.optimal_order_quantity) for r in plan] == [("optimal", 15.0), ("optimal", 0.0)]
    tight = inventory.order_plan(items, budget=29.0).collect()
    assert {(r.status, r.optimal_order_quantity) for r in tight} == {("infeasible", None)}
    with pytest.raises(Exception, match="negative price"):
        inventory.order_plan(items.withColumn("unit_cost", F.lit(-1.0))).collect()


def test_optimise_defaults_and_zero_demand(spark):
    rows = inventory.optimise_stock(
        spark.createDataFrame([(1, 0.0), (2, 10.0)], "item_id long, forecast double")
    ).orderBy("item_id").collect()
    assert (rows[0].eoq, rows[0].safety_stock, rows[0].total_cost) == (0.0, 0.0, 0.0)
    assert rows[1].recommended_order == rows[1].eoq > 0 and rows[1].inventory_turns == 3650


def test_dynamic_safety_stock(spark):
    df = spark.createDataFrame([("a", 1, 100.0, 5.0), ("a", 2, 100.0, -15.0), ("a", 3, 100.0, 1.0)],
                               "k string, t int, forecast double, error double")
    rows = inventory.dynamic_safety_stock(df, ["k"], "t", 9).orderBy("t").collect()
    assert [r.error_std for r in rows] == [0.0, 5.0, 10.0]
    assert [r.service_level for r in rows] == [0.90, 0.90, 0.95]
    assert rows[1].safety_stock == pytest.approx(NormalDist().inv_cdf(0.90) * 5 * 3)


def test_dynamic_reorder_point(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3)], "k string, t int, forecast double")
    assert inventory.dynamic_reorder_point(df, ["k"], "t", 2, 10).first().reorder_point == 13
    assert inventory.dynamic_reorder_point(df, ["k"], "t", 5, 10).first().reorder_point == 20
    assert inventory.dynamic_reorder_point(df, ["k"], "t", 0.5, 10).first().reorder_point == 10


def test_seasonal_safety_stock(spark):
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(4)] + [("b", 0, 3.0)], "k string, t int, d double")
    rows = inventory.seasonal_safety_stock(df, ["k"], "t", "d", 4, season=2).orderBy("k", "period").collect()
    assert [(r.k, r.period, r.demand_mean) for r in rows] == [("a", 0, 0.0), ("a", 1, 1.0), ("b", -1, 3.0)]


def test_kpis_only_with_their_columns(spark):
    out = inventory.inventory_kpis(spark.createDataFrame([(0, 0)], "stockouts int, total_orders int"))
    assert out.columns == ["items", "fill_rate"] and out.first().fill_rate == 0


def test_stage_joins_by_key(spark):
    from shelfcast.plans.inventory import stock_stage

    fc = spark.createDataFrame([(1, "A", 4.0), (1, "A", 6.0), (2, "A", 1.0), (9, "A", 1.0)], "store_nbr int, family string, forecast double")
    shelf = spark.createDataFrame([(0, 1, "A", 3.0), (1, 2, "A", 900.0)], "item_id long, store_nbr int, family string, current_inventory double")
    rows = {r.item_id: r for r in stock_stage(fc, shelf).collect()}
    assert set(rows) == {0, 1} and rows[0].demand_forecast == 5.0 and rows[0].priority == "Critical"
