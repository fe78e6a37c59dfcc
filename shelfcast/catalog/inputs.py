"""The logical tables, derived from the given ones, in Spark and as SQL text.

Sales are line quantities (whole numbers), so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.functions.safe import nan_to_null

HORIZON = 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def sales_lines(spark, folder) -> DataFrame:
    """One row per sold line: date, store, family, quantity, promotion mark.

    Part and supplier are joined on their keys; the planner broadcasts them only while they are
    small and otherwise splits a hot key at run time (adaptive skew join).
    """
    line = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate"
    )
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            F.to_date("l_shipdate").alias("date"),
            F.col("s_nationkey").alias("store_nbr"),
            F.col("p_type").alias("family"),
            F.col("l_quantity").alias("sales"),
            F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("onpromotion"),
        )
    )


def panel(spark, folder) -> DataFrame:
    """Daily sales per store and family; lines are summed map-side before the shuffle."""
    return sales_lines(spark, folder).groupBy("date", "store_nbr", "family").agg(
        F.sum("sales").alias("sales"), F.sum("onpromotion").alias("onpromotion")
    )


PANEL = """lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr, p_type AS family,
         l_quantity AS sales, CASE WHEN l_discount >= CAST(0.08 AS DOUBLE) THEN 1 ELSE 0 END AS onpromotion
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
panel AS (
  SELECT date, store_nbr, family, SUM(sales) AS sales, CAST(SUM(onpromotion) AS BIGINT) AS onpromotion
  FROM lines GROUP BY date, store_nbr, family)"""


def feed(spark, folder) -> DataFrame:
    """The lines as an untyped feed: text columns, some of them broken or empty."""
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    bad_date = (F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 1)
    bad_sales = (F.col("l_tax") == 0.07) & (F.col("l_linenumber") == 2)
    no_promo = (F.col("l_tax") == 0.06) & (F.col("l_linenumber") == 3)
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            F.when(bad_date, "not a date")
            .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
            .alias("date"),
            F.col("s_nationkey").alias("store_nbr"),
            F.col("p_type").alias("family"),
            F.when(bad_sales, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("sales"),
            F.when(no_promo, F.lit(None).cast("string"))
            .otherwise(F.when(F.col("l_discount") >= 0.08, "1").otherwise("0"))
            .alias("onpromotion"),
        )
    )


FEED = """feed AS (
  SELECT CASE WHEN l_tax = CAST(0.08 AS DOUBLE) AND l_linenumber = 1 THEN 'not a date'
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         s_nationkey AS store_nbr, p_type AS family,
         CASE WHEN l_tax = CAST(0.07 AS DOUBLE) AND l_linenumber = 2 THEN 'n/a'
              ELSE CAST(l_quantity AS VARCHAR) END AS sales,
         CASE WHEN l_tax = CAST(0.06 AS DOUBLE) AND l_linenumber = 3 THEN NULL
              WHEN l_discount >= CAST(0.08 AS DOUBLE) THEN '1' ELSE '0' END AS onpromotion
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
typed AS (
  SELECT TRY_CAST(date AS DATE) AS date, store_nbr, family, TRY_CAST(sales AS DOUBLE) AS sales,
         TRY_CAST(onpromotion AS DOUBLE) AS onpromotion FROM feed)"""


def stores(spark, folder) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.substring("n_name", 1, 1).alias("type"),
        (F.col("n_regionkey") + 1).alias("cluster"),
    )


STORES = """stores AS (
  SELECT n_nationkey AS store_nbr, n_name AS city, r_name AS state, substr(n_name, 1, 1) AS type, n_regionkey + 1 AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def oil(spark, folder) -> DataFrame:
    """Daily index from order values: missing on Mondays, absent on weekends.

    Values are summed in whole cents, so the mean does not depend on the order of rows.
    """
    day = F.to_date("o_orderdate")
    daily = table(spark, folder, "orders").groupBy(day.alias("date")).agg(
        (
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / F.count("o_totalprice") / 100
        ).alias("_p")
    )
    return daily.where(F.weekday("date") < 5).select(
        "date", F.when(F.weekday("date") != 0, F.col("_p")).alias("dcoilwtico")
    )


OIL = """oil AS (
  SELECT date, CASE WHEN isodow(date) <> 1 THEN p END AS dcoilwtico
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
          / COUNT(o_totalprice) / 100 AS p FROM orders GROUP BY 1)
  WHERE isodow(date) <= 5)"""


def holidays(spark, folder) -> DataFrame:
    """Order dates on fixed feast days; one row per kind seen that day, so dates repeat."""
    day = F.to_date("o_orderdate")
    return (
        table(spark, folder, "orders")
        .where(F.date_format(day, "MM-dd").isin("01-01", "05-01", "07-04", "12-25"))
        .groupBy(
            day.alias("date"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("locale")
        )
        .agg((F.max("o_totalprice") > 450000).alias("transferred"))
    )


HOLIDAYS = """holidays AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type, o_orderstatus AS locale,
         MAX(o_totalprice) > 450000 AS transferred
  FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '07-04', '12-25') GROUP BY 1, 2, 3)"""


def transactions(spark, folder) -> DataFrame:
    """Lines sold per day and store."""
    return sales_lines(spark, folder).groupBy("date", "store_nbr").agg(
        F.count(F.lit(1)).cast("double").alias("transactions")
    )


TRANSACTIONS = """transactions AS (
  SELECT date, store_nbr, CAST(COUNT(*) AS DOUBLE) AS transactions FROM lines GROUP BY 1, 2)"""


def future(spark, folder, horizon: int = HORIZON, history: DataFrame | None = None) -> DataFrame:
    """Every series for the days after the last date, promotion every seventh day; ``history`` is a stored panel."""
    history = panel(spark, folder) if history is None else history
    last = history.agg(F.max("date")).scalar()
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h")
    return (
        history.select("store_nbr", "family").distinct().withColumn("_last", last).select("*", ahead)
        .select(
            F.date_add("_last", F.col("_h")).alias("date"),
            "store_nbr",
            "family",
            F.when(F.col("_h") % 7 == 0, 1).otherwise(0).cast("long").alias("onpromotion"),
        )
    )


FUTURE = f"""future AS (
  SELECT CAST(mx + CAST(h AS INTEGER) AS DATE) AS date, store_nbr, family,
         CAST(CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS onpromotion
  FROM (SELECT DISTINCT store_nbr, family FROM panel), (SELECT MAX(date) AS mx FROM panel),
       (SELECT unnest(generate_series(1, {HORIZON})) AS h))"""


def predictions(spark, folder) -> DataFrame:
    """Actual sales beside the value seven rows earlier in the series."""
    w = Window.partitionBy("store_nbr", "family").orderBy("date")
    return (
        panel(spark, folder)
        .select(
            "date", "store_nbr", "family", F.col("sales").alias("actual"), F.lag("sales", 7).over(w).alias("predicted")
        )
        .where(F.col("predicted").isNotNull())
    )


PREDICTIONS = """predictions AS (
  SELECT * FROM (
    SELECT date, store_nbr, family, sales AS actual,
           lag(sales, 7) OVER (PARTITION BY store_nbr, family ORDER BY date) AS predicted FROM panel)
  WHERE predicted IS NOT NULL)"""


def forecasts(spark, folder) -> DataFrame:
    """Future rows with the series' mean and spread over its last 30 rows as forecast and bounds."""
    w = Window.partitionBy("store_nbr", "family").orderBy(F.col("date").desc())
    recent = panel(spark, folder).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 30)
    level = recent.groupBy("store_nbr", "family").agg(
        F.avg("sales").alias("_m"), F.stddev_pop("sales").alias("_s")
    )
    shape = F.lit(1.0) + F.lit(0.1) * F.sin(F.dayofmonth("date"))
    point = F.col("_m") * shape
    return future(spark, folder).join(level, ["store_nbr", "family"]).select(
        "date",
        "store_nbr",
        "family",
        point.alias("forecast"),
        (point - F.lit(1.2815515655446004) * F.col("_s")).alias("forecast_lo"),
        (point + F.lit(1.2815515655446004) * F.col("_s")).alias("forecast_hi"),
    )


FORECASTS = """forecasts AS (
  SELECT f.date, f.store_nbr, f.family, m * sh AS forecast,
         m * sh - CAST(1.2815515655446004 AS DOUBLE) * s AS forecast_lo,
         m * sh + CAST(1.2815515655446004 AS DOUBLE) * s AS forecast_hi
  FROM (SELECT *, CAST(1.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * sin(day(date)) AS sh FROM future) f
  JOIN (SELECT store_nbr, family, AVG(sales) AS m, STDDEV_POP(sales) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, family ORDER BY date DESC) AS r FROM panel)
        WHERE r <= 30 GROUP BY 1, 2) l ON f.store_nbr = l.store_nbr AND f.family = l.family)"""


def item_demand(spark, folder) -> DataFrame:
    """Quantity per item and day."""
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("item_id"), F.to_date("l_shipdate").alias("date")
    ).agg(F.sum("l_quantity").alias("demand"))


ITEM_DEMAND = """item_demand AS (
  SELECT l_partkey AS item_id, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS demand
  FROM lineitem GROUP BY 1, 2)"""


def items(spark, folder) -> DataFrame:
    """One row per item: demand mean and std, stock, cost and lead time."""
    demand = item_demand(spark, folder).groupBy("item_id").agg(
        F.avg("demand").alias("demand_mean"),
        F.coalesce(F.stddev_samp("demand"), F.lit(0.0)).alias("demand_std"),
        F.sum("demand").alias("total_demand"),
        F.count(F.lit(1)).alias("demand_days"),
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("family"),
        F.col("p_retailprice").alias("unit_cost"),
        (F.col("p_partkey") * 37 % 1400).cast("double").alias("current_inventory"),
        (F.col("p_partkey") % 21 + 7).cast("int").alias("lead_time"),
    )
    return part.join(demand, "item_id").select(
        "item_id", "family", "current_inventory", "unit_cost", "lead_time", "demand_mean", "demand_std",
        "total_demand", "demand_days",
        (F.col("total_demand") * F.col("unit_cost")).alias("annual_value"),
    )


ITEMS = ITEM_DEMAND + """,
items AS (
  SELECT p_partkey AS item_id, p_type AS family, CAST(p_partkey * 37 % 1400 AS DOUBLE) AS current_inventory,
         p_retailprice AS unit_cost, CAST(p_partkey % 21 + 7 AS INTEGER) AS lead_time,
         demand_mean, demand_std, total_demand, demand_days, total_demand * p_retailprice AS annual_value
  FROM part JOIN (SELECT item_id, AVG(demand) AS demand_mean, COALESCE(STDDEV_SAMP(demand), 0) AS demand_std,
                         SUM(demand) AS total_demand, COUNT(*) AS demand_days FROM item_demand GROUP BY 1) d
       ON p_partkey = d.item_id)"""


def rounded(df: DataFrame, digits: int = 4, keep=()) -> DataFrame:
    """Comparable output: doubles rounded, whole numbers as bigint, dates as they are."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0) if f.name not in keep else c
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
