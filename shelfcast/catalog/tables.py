"""Sources, sinks and selections."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import KEYS, b, r, with_
from shelfcast.operators import features, profile
from shelfcast.plans.durable import run_folder
from shelfcast.sources import tables as io


def scratch(spark, name):
    """A fresh folder in shared storage."""
    import uuid

    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


PANEL_ROWS = f"SELECT {KEYS}, {r('sales', 'sales')}, onpromotion FROM panel"


def stored(spark, table, df, fmt="csv", folder=None):
    """Write a derived table in the layout of the raw files; its path."""
    columns = [c for c in io.SCHEMAS[table].fieldNames() if c in df.columns]
    path = f"{folder or scratch(spark, table)}/{table}.{fmt}"
    return io.write_table(df.select(*columns), path)


@query("S1_sales_scan", with_(src.PANEL, f"SELECT {KEYS}, sales, CAST(onpromotion AS BIGINT) AS onpromotion FROM lines"))
def s1(spark, folder):
    return rounded(io.load_train(spark, stored(spark, "train", src.sales_lines(spark, folder))))


@query("S2_future_scan", with_([src.PANEL, src.FUTURE], f"SELECT {KEYS}, onpromotion FROM future"))
def s2(spark, folder):
    future = src.future(spark, folder).withColumn("onpromotion", F.col("onpromotion").cast("int"))
    return rounded(io.load_test(spark, stored(spark, "test", future, "parquet")))


@query("S3_stores_scan", with_(src.STORES, f"SELECT {b('store_nbr', 'store_nbr')}, city, state, type, {b('cluster', 'cluster')} FROM stores"))
def s3(spark, folder):
    return rounded(io.load_stores(spark, stored(spark, "stores", src.stores(spark, folder))))


@query("S4_oil_scan", with_(src.OIL, f"SELECT date, {r('dcoilwtico', 'dcoilwtico')} FROM oil"))
def s4(spark, folder):
    return rounded(io.load_oil(spark, stored(spark, "oil", src.oil(spark, folder), "json")))


@query("S5_holidays_scan", with_(src.HOLIDAYS, "SELECT date, type, locale, transferred FROM holidays"))
def s5(spark, folder):
    return io.load_holidays(spark, stored(spark, "holidays", src.holidays(spark, folder), "orc"))


@query(
    "S6_transactions_scan",
    with_([src.PANEL, src.TRANSACTIONS], f"SELECT date, {b('store_nbr', 'store_nbr')}, transactions FROM transactions"),
)
def s6(spark, folder):
    loaded = io.load_transactions(spark, stored(spark, "transactions", src.transactions(spark, folder), "parquet"))
    return rounded(loaded)


@query(
    "S7_named_set",
    with_(
        [src.PANEL, src.FUTURE, src.STORES, src.OIL, src.HOLIDAYS, src.TRANSACTIONS],
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, COUNT(*) AS rows FROM {t}"
            for n, t in (
                ("train", "panel"), ("test", "future"), ("stores", "stores"), ("oil", "oil"),
                ("holidays", "holidays"), ("transactions", "transactions"),
            )
        ),
    ),
)
def s7(spark, folder):
    """The whole set, written as CSV into one folder and loaded by name."""
    tables = {
        "train": src.panel, "test": src.future, "stores": src.stores, "oil": src.oil,
        "holidays": src.holidays, "transactions": src.transactions,
    }
    place = scratch(spark, "raw")
    for name, fn in tables.items():
        stored(spark, name, fn(spark, folder), folder=place)
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        for n, df in io.load_all(spark, place).items()
    ]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


@query(
    "S8_summary",
    with_(
        src.FEED,
        """SELECT COUNT(*) AS rows, CAST(5 AS BIGINT) AS columns,
        COUNT(*) - COUNT(date) AS nulls_date, COUNT(*) - COUNT(store_nbr) AS nulls_store_nbr,
        COUNT(*) - COUNT(family) AS nulls_family, COUNT(*) - COUNT(sales) AS nulls_sales,
        COUNT(*) - COUNT(onpromotion) AS nulls_onpromotion, MIN(date) AS date_min, MAX(date) AS date_max FROM typed""",
    ),
)
def s8(spark, folder):
    from shelfcast.operators.cleaning import coerce_types

    return rounded(profile.summarise(coerce_types(src.feed(spark, folder))))


@query("S9_write_and_read_panel", with_(src.PANEL, PANEL_ROWS + " WHERE date BETWEEN DATE '1997-03-15' AND DATE '1999-02-10'"))
def s9(spark, folder):
    path = io.write_panel(src.panel(spark, folder), scratch(spark, "panel"))
    return rounded(io.read_panel(spark, path, "1997-03-15", "1999-02-10"))


SERIES_SQL = """f AS (SELECT date, store_nbr, family,
  AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sales_rolling_mean_7,
  lag(sales, 7) OVER (PARTITION BY store_nbr, family ORDER BY date) AS sales_lag_7,
  AVG(sales) OVER (PARTITION BY store_nbr, family) AS store_family_mean_sales FROM panel)"""


@query(
    "S9_series_table",
    with_(
        [src.PANEL, SERIES_SQL],
        f"SELECT {KEYS}, {', '.join(r(c, c) for c in ('sales_rolling_mean_7', 'sales_lag_7', 'store_family_mean_sales'))} FROM f",
    ),
)
def s9_series(spark, folder):
    """Windows and the series mean on a table in buckets of whole series, without a shuffle after the scan."""
    path = scratch(spark, "series")
    stored = io.write_series(src.panel(spark, folder), path, "series_" + path[-32:])
    wide = features.add_lags(features.add_rolling(stored, windows=(7,), fill=False), lags=(7,), promo_lags=())
    wide = wide.withColumn("store_family_mean_sales", features.series_mean(features.series_window(wide)))
    return rounded(wide.select("date", "store_nbr", "family", "sales_rolling_mean_7", "sales_lag_7", "store_family_mean_sales"))


@query("S10_present_columns", with_(src.PANEL, f"SELECT date, {b('store_nbr', 'store_nbr')}, {r('sales', 'sales')} FROM panel"))
def s10(spark, folder):
    return rounded(io.select_present(src.panel(spark, folder), ["date", "store_nbr", "city", "sales", "cluster"]))


@query(
    "S11_outputs",
    with_(
        [src.PANEL, src.FUTURE, src.FORECASTS, src.ITEMS],
        """SELECT 'features' AS output, COUNT(*) AS rows FROM panel
        UNION ALL SELECT 'forecasts', COUNT(*) FROM forecasts
        UNION ALL SELECT 'recommendations', COUNT(*) FROM items
        UNION ALL SELECT 'abc', COUNT(*) FROM items
        UNION ALL SELECT 'backtest', CAST(5 AS BIGINT)""",
    ),
)
def s11(spark, folder):
    """All five outputs of a run, written and read back."""
    from shelfcast.operators import classify, inventory
    from shelfcast.plans import training
    from shelfcast.plans.durable import durable

    panel = durable(src.panel(spark, folder))
    items = durable(inventory.optimise_stock(src.items(spark, folder).withColumnRenamed("demand_mean", "forecast")))
    abc = classify.abc_classes(inventory.annual_value(items, unit_value=10.0))
    outputs = {
        "features": panel,
        "forecasts": src.forecasts(spark, folder),
        "recommendations": inventory.recommend(items),
        "abc": abc,
        "backtest": training.mean_backtest(panel),
    }
    paths = io.write_outputs(outputs, scratch(spark, "run"))
    counts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("output"), "rows")
        for n, p in paths.items()
    ]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


@query("S12_page_export", with_(src.PANEL, f"SELECT {KEYS}, {r('sales', 'sales')} FROM panel WHERE family IN ('PROMO', 'SMALL')"))
def s12(spark, folder):
    chosen = profile.page_filter(src.panel(spark, folder), families=["PROMO", "SMALL"])
    path = io.export_page(chosen, scratch(spark, "export"), ["date", "store_nbr", "family", "sales"])
    schema = "date date, store_nbr int, family string, sales double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query(
    "C15_page_filter",
    with_(
        src.PANEL,
        PANEL_ROWS
        + """ WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND store_nbr IN (1, 3, 5, 7, 11)
        AND family IN ('PROMO', 'LARGE', 'SMALL')""",
    ),
)
def c15(spark, folder):
    return rounded(
        profile.page_filter(
            src.panel(spark, folder), "1996-01-01", "2000-12-31", [1, 3, 5, 7, 11], ["PROMO", "LARGE", "SMALL"]
        )
    )


@query("C15_page_filter_all", with_(src.PANEL, PANEL_ROWS))
def c15_all(spark, folder):
    return rounded(profile.page_filter(src.panel(spark, folder), stores=["All"], families="All"))


@query(
    "C16_date_bounds",
    with_(
        [src.PANEL, src.FUTURE],
        """SELECT MIN(date) AS date_min, MAX(date) AS date_max
        FROM (SELECT date FROM panel UNION ALL SELECT date FROM future)""",
    ),
)
def c16_bounds(spark, folder):
    return profile.date_bounds(src.panel(spark, folder), src.future(spark, folder))


@query(
    "C16_filter_choices",
    with_(
        src.PANEL,
        """SELECT DISTINCT 'store_nbr' AS "column", CAST(store_nbr AS VARCHAR) AS value FROM panel
        UNION ALL SELECT DISTINCT 'family', family FROM panel""",
    ),
)
def c16_choices(spark, folder):
    return profile.distinct_values(src.panel(spark, folder), "store_nbr", "family")


@query("U3_distinct_keys", with_(src.PANEL, f"SELECT DISTINCT {b('store_nbr', 'store_nbr')}, family FROM panel"))
def u3(spark, folder):
    return rounded(src.panel(spark, folder).dropDuplicates(["store_nbr", "family"]).select("store_nbr", "family"))


@query(
    "U1_history_and_future",
    with_(
        [src.PANEL, src.FUTURE],
        f"""SELECT {KEYS}, {r('sales', 'sales')}, onpromotion, is_future FROM (
        SELECT date, store_nbr, family, sales, onpromotion, false AS is_future FROM panel
        UNION ALL SELECT date, store_nbr, family, NULL, onpromotion, true FROM future)""",
    ),
)
def u1(spark, folder):
    from shelfcast.plans.forecasting import history_with_future

    return rounded(history_with_future(src.panel(spark, folder), src.future(spark, folder)))


@query(
    "U1_whole_history_and_future",
    with_(
        [src.PANEL, src.FUTURE],
        f"""SELECT {KEYS}, {r('sales', 'sales')}, onpromotion, is_future FROM (
        SELECT date, store_nbr, family, sales, onpromotion, false AS is_future FROM panel
        UNION ALL SELECT date, store_nbr, family, NULL, onpromotion, true FROM future)""",
    ),
)
def u1_whole(spark, folder):
    """The whole history, as ``forecast`` uses it."""
    from shelfcast.plans.forecasting import history_with_future

    return rounded(history_with_future(src.panel(spark, folder), src.future(spark, folder)))
