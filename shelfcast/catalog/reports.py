"""Report page queries."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.inventory import HEALTH, RECS, RESULTS, recommendations
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import b, r, with_
from shelfcast.operators.cleaning import sort_panel
from shelfcast.operators import classify, reports

FAMILIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
STORE = b("store_nbr", "store_nbr")
STOCK = [src.ITEMS, RESULTS, RECS]
DAILY = "daily AS (SELECT date, SUM(sales) AS sales FROM panel GROUP BY 1)"


@query(
    "A1_headline",
    with_(
        [src.PANEL, *STOCK],
        f"""SELECT COUNT(*) FILTER (priority = 'Critical') AS critical_items, {r('AVG(inventory_turns)', 'mean_turns')},
        (SELECT SUM(sales) FROM panel) AS total_sales FROM recs""",
    ),
)
def a1(spark, folder):
    return rounded(reports.headline(src.panel(spark, folder), recommendations(spark, folder)))


@query("A2_daily_total", with_([src.PANEL, DAILY], "SELECT date, sales FROM daily"))
def a2(spark, folder):
    return rounded(reports.daily_total(src.panel(spark, folder)))


@query("A2_last_40_days", with_([src.PANEL, DAILY], "SELECT date, sales FROM daily ORDER BY date DESC LIMIT 40"))
def a2_last(spark, folder):
    return rounded(reports.last_days(reports.daily_total(src.panel(spark, folder)), 40))


@query(
    "A3_monthly_total",
    with_(
        [
            src.PANEL,
            """months AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, SUM(sales) AS sales FROM panel GROUP BY 1),
            spine AS (SELECT CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM months),
            filled AS (SELECT month, COALESCE(sales, 0) AS sales FROM spine LEFT JOIN months USING (month))""",
        ],
        f"""SELECT month, sales, {r('AVG(sales) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'trailing_mean')}
        FROM filled""",
    ),
)
def a3(spark, folder):
    return rounded(reports.monthly_total(src.panel(spark, folder)))


@query(
    "A4_priority_mix",
    with_(
        STOCK,
        f"""SELECT priority, COUNT(*) AS items,
        {r("100.0 * (SELECT COUNT(*) FILTER (priority NOT IN ('Critical', 'High')) / CAST(COUNT(*) AS DOUBLE) FROM recs)", 'healthy_percent')}
        FROM recs GROUP BY 1""",
    ),
)
def a4(spark, folder):
    return rounded(reports.priority_mix(recommendations(spark, folder)))


@query(
    "A5_critical_items",
    with_(
        STOCK,
        f"""SELECT item_id, {r('current_inventory', 'current_inventory')}, {r('safety_stock', 'safety_stock')}
        FROM recs WHERE priority = 'Critical' ORDER BY item_id LIMIT 5""",
    ),
)
def a5(spark, folder):
    return rounded(reports.critical_items(recommendations(spark, folder)))


@query("A6_top_stores", with_(src.PANEL, f"SELECT {STORE}, SUM(sales) AS sales FROM panel GROUP BY panel.store_nbr ORDER BY 2 DESC, 1 LIMIT 6"))
def a6(spark, folder):
    return rounded(reports.total_by(src.panel(spark, folder), "store_nbr", "sales", 6))


@query("A7_sales_by_family", with_(src.PANEL, "SELECT family, SUM(sales) AS sales FROM panel GROUP BY 1"))
def a7(spark, folder):
    return rounded(reports.total_by(src.panel(spark, folder), "family", "sales"))


@query(
    "A8_week_matrix",
    with_(
        [src.PANEL, DAILY],
        f"SELECT {b('isodow(date) - 1', 'weekday')}, "
        + ", ".join(f'SUM(CASE WHEN weekofyear(date) = {w} THEN sales END) AS "{w}"' for w in range(1, 54))
        + " FROM daily GROUP BY 1",
    ),
)
def a8(spark, folder):
    return rounded(reports.week_matrix(src.panel(spark, folder)))


@query(
    "A9_composition",
    with_(
        src.PANEL,
        f"""SELECT {STORE}, family, SUM(sales) AS sales, {b('grouping(panel.store_nbr, family)', 'level')}
        FROM panel GROUP BY ROLLUP (panel.store_nbr, family)""",
    ),
)
def a9(spark, folder):
    return rounded(reports.composition(src.panel(spark, folder)))


@query("A10_mean_by_month", with_(src.PANEL, f"SELECT {b('month(date)', 'month')}, {r('AVG(sales)', 'mean_sales')} FROM panel GROUP BY 1"))
def a10(spark, folder):
    return rounded(reports.mean_by_month(src.panel(spark, folder)))


@query(
    "A11_mean_by_weekday",
    with_(
        src.PANEL,
        f"SELECT {b('isodow(date) - 1', 'weekday')}, dayname(date) AS day_name, {r('AVG(sales)', 'mean_sales')} FROM panel GROUP BY 1, 2",
    ),
)
def a11(spark, folder):
    return rounded(reports.mean_by_weekday(src.panel(spark, folder)))


@query(
    "A12_distribution_by_family",
    with_(
        src.PANEL,
        f"""SELECT family, MIN(sales) AS minimum, {r('quantile_cont(sales, 0.25)', 'q1')}, {r('quantile_cont(sales, 0.5)', 'median')},
        {r('quantile_cont(sales, 0.75)', 'q3')}, MAX(sales) AS maximum FROM panel GROUP BY 1""",
    ),
)
def a12(spark, folder):
    return rounded(reports.distribution_by(src.panel(spark, folder), "family"))


@query(
    "A13_log_histogram",
    with_(
        [
            src.PANEL,
            """logged AS (SELECT ln(1 + greatest(sales, CAST(0.01 AS DOUBLE))) AS x FROM panel),
            edge AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM logged)""",
        ],
        """SELECT CAST(least(COALESCE(floor((x - lo) / NULLIF((hi - lo) / 55.0, 0)) + 1, 1), 55) AS BIGINT) AS bin, COUNT(*) AS rows
        FROM logged, edge GROUP BY 1""",
    ),
)
def a13(spark, folder):
    return reports.log_histogram(src.panel(spark, folder))


FC = [src.PANEL, src.FUTURE, src.FORECASTS]


@query(
    "A14_forecast_by_day",
    with_(
        FC,
        f"""SELECT date, {r('SUM(forecast)', 'forecast')}, {r('greatest(SUM(forecast_lo), 0)', 'lo')},
        {r('SUM(forecast_hi)', 'hi')} FROM forecasts GROUP BY 1""",
    ),
)
def a14(spark, folder):
    return rounded(reports.forecast_by_day(src.forecasts(spark, folder)))


@query(
    "A14_forecast_by_day_heuristic",
    with_(
        FC,
        f"""SELECT date, {r('SUM(forecast)', 'forecast')}, {r('greatest(SUM(forecast) * (1 - 0.1645), 0)', 'lo')},
        {r('SUM(forecast) * 1.1645', 'hi')} FROM forecasts GROUP BY 1""",
    ),
)
def a14_band(spark, folder):
    return rounded(reports.forecast_by_day(src.forecasts(spark, folder).drop("forecast_lo", "forecast_hi")))


@query(
    "A15_history_and_forecast",
    with_(
        [*FC, DAILY],
        f"""SELECT * FROM (SELECT date, 'history' AS kind, sales + 0 AS value FROM daily ORDER BY date DESC LIMIT 60)
        UNION ALL SELECT date, 'forecast', {r('SUM(forecast)', 'value')} FROM forecasts GROUP BY 1""",
    ),
)
def a15(spark, folder):
    return rounded(reports.history_and_forecast(src.panel(spark, folder), src.forecasts(spark, folder)))


@query("A16_forecast_by_family", with_(FC, f"SELECT family, {r('SUM(forecast)', 'forecast')} FROM forecasts GROUP BY 1"))
def a16(spark, folder):
    return rounded(reports.total_by(src.forecasts(spark, folder), "family", "forecast"))


@query("A17_forecast_by_store", with_(FC, f"SELECT {STORE}, {r('SUM(forecast)', 'forecast')} FROM forecasts GROUP BY forecasts.store_nbr"))
def a17(spark, folder):
    return rounded(reports.total_by(src.forecasts(spark, folder), "store_nbr", "forecast"))


@query(
    "A18_inventory_headline",
    with_(
        STOCK,
        f"""SELECT COUNT(*) AS items, COUNT(*) FILTER (priority = 'Critical') AS critical_items,
        COUNT(*) FILTER (recommended_order > 0) AS pending_reorders, {r('AVG(inventory_turns)', 'mean_turns')} FROM recs""",
    ),
)
def a18(spark, folder):
    return rounded(reports.inventory_headline(recommendations(spark, folder)))


@query(
    "A19_reorder_queue",
    with_(
        STOCK,
        f"""SELECT item_id, priority, {r('current_inventory', 'current_inventory')}, {r('reorder_point', 'reorder_point')},
        {r('safety_stock', 'safety_stock')}, {r('recommended_order', 'recommended_order')}, {r(HEALTH, 'stock_health')}
        FROM recs WHERE recommended_order > 0 ORDER BY priority_rank, item_id LIMIT 18""",
    ),
)
def a19(spark, folder):
    return rounded(reports.reorder_queue(recommendations(spark, folder)))


PARETO = """curve AS (
  SELECT *, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (
    SELECT item_id, v, SUM(v) OVER w / SUM(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, item_id) AS i,
           COUNT(*) OVER () AS n
    FROM (SELECT item_id, current_inventory * unit_cost AS v FROM items)
    WINDOW w AS (ORDER BY v DESC, item_id ROWS UNBOUNDED PRECEDING)))"""


def pareto(spark, folder):
    df = src.items(spark, folder)
    return classify.pareto(df.select("item_id", (F.col("current_inventory") * F.col("unit_cost")).alias("value")), "value")


@query(
    "A20_pareto",
    with_([src.ITEMS, PARETO],
          f"SELECT item_id, {r('v', 'value')}, {r('share * 100', 'cumulative_percent')}, {r('100.0 * i / n', 'item_percent')}, abc_class FROM curve"),
)
def a20(spark, folder):
    return rounded(pareto(spark, folder))


@query(
    "A20_pareto_summary",
    with_(
        [src.ITEMS, PARETO],
        f"""SELECT abc_class, COUNT(*) AS items, {r('SUM(v)', 'value', 2)},
        {r('100.0 * SUM(v) / (SELECT SUM(v) FROM curve)', 'value_percent', 2)} FROM curve GROUP BY 1""",
    ),
)
def a20_summary(spark, folder):
    from shelfcast.plans.durable import durable

    return rounded(classify.pareto_summary(durable(pareto(spark, folder)), "value"), 2)


@query(
    "A21_inventory_snapshot",
    with_(STOCK, f"SELECT item_id, priority, {r('reorder_point', 'reorder_point')}, {r('eoq', 'eoq')} FROM recs"),
)
def a21(spark, folder):
    columns = ["item_id", "priority", "reorder_point", "eoq", "warehouse"]
    return rounded(reports.snapshot(recommendations(spark, folder), columns))


def pivot_sql(value):
    return ", ".join(f"MAX(CASE WHEN family = '{f}' THEN {value} END) AS \"{f}\"" for f in FAMILIES)


PAIRS = """pairs AS (SELECT store_nbr, family, SUM(sales) AS v FROM panel GROUP BY 1, 2),
scaled AS (SELECT *, round(v / NULLIF(MAX(v) OVER (PARTITION BY store_nbr), 0), 4) + 0 AS s FROM pairs)"""


@query("A22_store_matrix", with_([src.PANEL, PAIRS], f"SELECT {STORE}, {pivot_sql('v')} FROM pairs GROUP BY pairs.store_nbr"))
def a22(spark, folder):
    return rounded(reports.store_matrix(src.panel(spark, folder)))


@query("A23_store_matrix_scaled", with_([src.PANEL, PAIRS], f"SELECT {STORE}, {pivot_sql('s')} FROM scaled GROUP BY scaled.store_nbr"))
def a23(spark, folder):
    return rounded(reports.store_matrix_scaled(src.panel(spark, folder)))


@query(
    "A24_store_ranking",
    with_(
        [
            src.PANEL,
            """rows_ AS (SELECT store_nbr, SUM(sales) AS t, AVG(sales) AS a, STDDEV_SAMP(sales) AS s FROM panel GROUP BY 1),
            days AS (SELECT store_nbr, AVG(v) AS d FROM (SELECT store_nbr, date, SUM(sales) AS v FROM panel GROUP BY 1, 2) GROUP BY 1)""",
        ],
        f"""SELECT row_number() OVER (ORDER BY t DESC, store_nbr) AS rank, {STORE}, t AS total_sales, {r('a', 'avg_row_sales')},
        {r('d', 'avg_daily_sales')}, {r('s / NULLIF(a, 0)', 'cv')},
        {r('100.0 * (t - AVG(t) OVER ()) / AVG(t) OVER ()', 'percent_vs_mean')} FROM rows_ JOIN days USING (store_nbr)""",
    ),
)
def a24(spark, folder):
    return rounded(reports.store_ranking(src.panel(spark, folder)))


@query(
    "A25_store_comparison",
    with_(
        [
            src.PANEL,
            """d AS (SELECT store_nbr, date, SUM(sales) AS v FROM panel WHERE store_nbr IN (3, 15) GROUP BY 1, 2),
            p AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY date) AS i,
            row_number() OVER (PARTITION BY store_nbr ORDER BY date DESC) AS j FROM d)""",
        ],
        f"""SELECT {STORE}, SUM(v) AS total_sales, {r('AVG(v)', 'daily_mean')}, MAX(v) AS peak, MIN(v) AS low,
        {r('STDDEV_SAMP(v)', 'std')},
        {r('100.0 * (AVG(v) FILTER (j <= 30) / greatest(AVG(v) FILTER (i <= 30), 1) - 1)', 'growth_percent')}
        FROM p GROUP BY p.store_nbr""",
    ),
)
def a25(spark, folder):
    return rounded(reports.compare_stores(src.panel(spark, folder), [3, 15]))


FRAME = "OVER (ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)"
FLAG = f"""flagged AS (SELECT *, COALESCE(CASE WHEN COUNT(sales) {FRAME} >= 5
  THEN ABS((sales - AVG(sales) {FRAME}) / (STDDEV_SAMP(sales) {FRAME} + 1e-9)) > 2.8 END, false) AS is_anomaly FROM daily)"""


@query("W12_anomalies", with_([src.PANEL, DAILY, FLAG], "SELECT date, sales, is_anomaly FROM flagged"))
def w12(spark, folder):
    return rounded(reports.anomalies(reports.daily_total(src.panel(spark, folder))))


@query(
    "W13_daily_trend",
    with_(
        [src.PANEL, DAILY, FLAG],
        f"""SELECT date, sales, is_anomaly, CASE WHEN COUNT(*) OVER w >= 3 THEN round(AVG(sales) OVER w, 4) + 0 END AS trailing_mean
        FROM flagged WINDOW w AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    ),
)
def w13(spark, folder):
    return rounded(reports.daily_trend(src.panel(spark, folder)))


@query("T1_sorted_keys", with_(src.PANEL, f"SELECT date, {STORE}, family, sales FROM panel ORDER BY 1, 2, 3"))
def t1(spark, folder):
    return rounded(sort_panel(src.panel(spark, folder).select("date", "store_nbr", "family", "sales")))


@query("T2_top_series", with_(src.PANEL, f"SELECT {STORE}, family, SUM(sales) AS sales FROM panel GROUP BY panel.store_nbr, family ORDER BY 3 DESC, 1, 2 LIMIT 18"))
def t2(spark, folder):
    totals = src.panel(spark, folder).groupBy("store_nbr", "family").agg(F.sum("sales").alias("sales"))
    return rounded(totals.orderBy(F.col("sales").desc(), "store_nbr", "family").limit(18))
