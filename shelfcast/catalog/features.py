"""Feature and join queries."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import BY_DATE, KEYS, SERIES, b, r, with_
from shelfcast.functions.stats import normal_quantile, z_value
from shelfcast.operators import external, features, grouped
from shelfcast.plans.features import engineer

ID = ["date", "store_nbr", "family"]
DIGITS = 4

# calendar

PARTS = ", ".join(
    [
        b("year(date)", "year"), b("month(date)", "month"), b("day(date)", "day"),
        b("isodow(date) - 1", "day_of_week"), b("dayofyear(date)", "day_of_year"),
        b("weekofyear(date)", "week_of_year"), b("quarter(date)", "quarter"),
    ]
)
FLAGS = """isodow(date) >= 6 AS is_weekend, day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end,
  day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS is_quarter_start,
  date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end,
  day(date) = 1 AND month(date) = 1 AS is_year_start, day(date) = 31 AND month(date) = 12 AS is_year_end"""
CYCLES = ", ".join(
    f"{fn}(2 * pi() * {part} / {n}.0) AS {name}_{fn}"
    for name, part, n in (("month", "month(date)", 12), ("day_of_week", "(isodow(date) - 1)", 7),
                          ("day_of_year", "dayofyear(date)", 365))
    for fn in ("sin", "cos")
)
CYCLE_NAMES = [f"{n}_{f}" for n in ("month", "day_of_week", "day_of_year") for f in ("sin", "cos")]


@query("D1_calendar_parts", with_(src.PANEL, f"SELECT {KEYS}, {PARTS} FROM panel"))
def d1(spark, folder):
    df = src.panel(spark, folder).select(*ID)
    return rounded(df.withColumns(features.calendar_parts(F.col("date"))))


@query("D2_calendar_flags", with_(src.PANEL, f"SELECT {KEYS}, {FLAGS} FROM panel"))
def d2(spark, folder):
    return rounded(src.panel(spark, folder).select(*ID).withColumns(features.calendar_flags(F.col("date"))))


@query(
    "D3_calendar_cycles",
    with_(
        [src.PANEL, f"cyc AS (SELECT date, store_nbr, family, {CYCLES} FROM panel)"],
        f"SELECT {KEYS}, {', '.join(r(c, c) for c in CYCLE_NAMES)} FROM cyc",
    ),
)
def d3(spark, folder):
    return rounded(src.panel(spark, folder).select(*ID).withColumns(features.calendar_cycles(F.col("date"))))


# lags and rolling statistics

SALES_LAGS = [f"sales_lag_{k}" for k in features.LAGS]
PROMO_LAGS = [f"onpromotion_lag_{k}" for k in features.PROMO_LAGS]
LAG_SQL = ", ".join(
    [f"lag(sales, {k}) OVER ({BY_DATE}) AS sales_lag_{k}" for k in features.LAGS]
    + [f"lag(onpromotion, {k}) OVER ({BY_DATE}) AS onpromotion_lag_{k}" for k in features.PROMO_LAGS]
)
STATS = (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))


def roll_sql(frame="ROWS BETWEEN {n} PRECEDING AND CURRENT ROW", less=1, windows=features.WINDOWS):
    return ", ".join(
        f"{fn}(sales) OVER ({BY_DATE} {frame.format(n=n - less)}) AS sales_rolling_{name}_{n}"
        for n in windows
        for name, fn in STATS
    )


ROLL_NAMES = [f"sales_rolling_{name}_{n}" for n in features.WINDOWS for name, _ in STATS]
ROLL = f"roll AS (SELECT date, store_nbr, family, {roll_sql()} FROM panel)"
ROLL_OUT = ", ".join(r(c, c) for c in ROLL_NAMES)


@query(
    "W1_target_lags",
    with_([src.PANEL, f"l AS (SELECT *, {LAG_SQL} FROM panel)"], f"SELECT {KEYS}, {', '.join(SALES_LAGS)} FROM l"),
)
def w1(spark, folder):
    return rounded(features.add_lags(src.panel(spark, folder), promo_lags=()).select(*ID, *SALES_LAGS))


@query(
    "W2_promotion_lags",
    with_([src.PANEL, f"l AS (SELECT *, {LAG_SQL} FROM panel)"], f"SELECT {KEYS}, {', '.join(PROMO_LAGS)} FROM l"),
)
def w2(spark, folder):
    return rounded(features.add_lags(src.panel(spark, folder), lags=()).select(*ID, *PROMO_LAGS))


@query("W3_rolling_statistics", with_([src.PANEL, ROLL], f"SELECT {KEYS}, {ROLL_OUT} FROM roll"))
def w3(spark, folder):
    return rounded(features.add_rolling(src.panel(spark, folder), fill=False).select(*ID, *ROLL_NAMES))


WIDE = (182, 365)
WIDE_NAMES = [f"sales_rolling_{name}_{n}" for n in WIDE for name, _ in STATS]


@query(
    "W3_rolling_wide",
    with_(
        [src.PANEL, f"p AS (SELECT date, store_nbr, family, {roll_sql('ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING', 0, WIDE)} FROM panel)"],
        f"SELECT {KEYS}, {', '.join(r(c, c) for c in WIDE_NAMES)} FROM p",
    ),
)
def w3_wide(spark, folder):
    return rounded(features.add_rolling_wide(src.panel(spark, folder), windows=WIDE, gap=1).select(*ID, *WIDE_NAMES))


PAST_NAMES = [c for c in ROLL_NAMES if c.endswith("_30")]


@query(
    "W3_rolling_past_only",
    with_(
        [src.PANEL, f"p AS (SELECT date, store_nbr, family, {roll_sql('ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING', 0, (30,))} FROM panel)"],
        f"SELECT {KEYS}, {', '.join(r(c, c) for c in PAST_NAMES)} FROM p",
    ),
)
def w3_past(spark, folder):
    df = features.add_rolling(src.panel(spark, folder), windows=(30,), gap=1, fill=False)
    return rounded(df.select(*ID, *PAST_NAMES))


W4_NAMES = [f"sales_rolling_{name}_7" for name, _ in STATS]


@query(
    "W4_rolling_filled",
    with_(
        [
            src.PANEL,
            "holes AS (SELECT * REPLACE (CASE WHEN month(date) NOT IN (3, 4) THEN sales END AS sales) FROM panel)",
            f"p AS (SELECT date, store_nbr, family, {roll_sql(windows=(7,))} FROM holes)",
            "f AS (SELECT date, store_nbr, family, "
            + ", ".join(
                f"last_value({c} IGNORE NULLS) OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
                for c in W4_NAMES
            )
            + " FROM p)",
        ],
        f"SELECT {KEYS}, {', '.join(r(c, c) for c in W4_NAMES)} FROM f",
    ),
)
def w4(spark, folder):
    holes = src.panel(spark, folder).withColumn("sales", F.when(~F.month("date").isin(3, 4), F.col("sales")))
    return rounded(features.add_rolling(holes, windows=(7,)).select(*ID, *W4_NAMES))


@query(
    "W5_ungrouped",
    with_(
        [src.PANEL, "d AS (SELECT date, SUM(sales) AS sales FROM panel GROUP BY 1)"],
        "SELECT date, "
        + ", ".join(
            [f"lag(sales, {k}) OVER (ORDER BY date) AS sales_lag_{k}" for k in features.LAGS]
            + [
                r(f"AVG(sales) OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"sales_rolling_mean_{n}")
                for n in features.WINDOWS
            ]
        )
        + " FROM d",
    ),
)
def w5(spark, folder):
    daily = src.panel(spark, folder).groupBy("date").agg(F.sum("sales").alias("sales"))
    return rounded(features.add_lags_ungrouped(daily, ["date"]).drop("sales"))


@query(
    "Q11_daily_spine",
    with_(
        [
            src.PANEL,
            """spine AS (SELECT store_nbr, family,
            CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel GROUP BY 1, 2),
            dense AS (SELECT s.date, s.store_nbr, s.family, p.sales, COALESCE(p.onpromotion, 0) AS onpromotion
            FROM spine s LEFT JOIN panel p ON s.date = p.date AND s.store_nbr = p.store_nbr AND s.family = p.family)""",
            f"l AS (SELECT *, lag(sales, 7) OVER ({BY_DATE}) AS lag7 FROM dense)",
        ],
        f"""SELECT {b('store_nbr', 'store_nbr')}, family, COUNT(*) AS days, COUNT(sales) AS days_with_sales,
        COUNT(lag7) AS days_with_lag, {r('SUM(lag7)', 'lag_total')} FROM l GROUP BY 1, 2""",
    ),
)
def q11(spark, folder):
    dense = features.add_lags(features.densify(src.panel(spark, folder)), lags=(7,), promo_lags=())
    return rounded(
        dense.groupBy("store_nbr", "family").agg(
            F.count(F.lit(1)).alias("days"),
            F.count("sales").alias("days_with_sales"),
            F.count("sales_lag_7").alias("days_with_lag"),
            F.sum("sales_lag_7").alias("lag_total"),
        )
    )


# promotions

PROMO_SQL = f"""AVG(onpromotion) OVER ({BY_DATE} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS promo_frequency_7d,
  AVG(onpromotion) OVER ({BY_DATE} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS promo_frequency_30d,
  COALESCE(lead(onpromotion) OVER ({BY_DATE}), 0) AS promo_next_day,
  COALESCE(lag(onpromotion) OVER ({BY_DATE}), 0) AS promo_prev_day"""


def run_sql(test="onpromotion = 1"):
    running = f"OVER ({BY_DATE} ROWS UNBOUNDED PRECEDING)"
    return f"""rn - COALESCE(MAX(CASE WHEN {test} THEN rn END) {running}, 0) AS days_since_promo,
    rn - COALESCE(MAX(CASE WHEN NOT ({test}) THEN rn END) {running}, 0) AS promo_streak"""


NUMBERED = f"numbered AS (SELECT *, row_number() OVER ({BY_DATE}) AS rn FROM panel)"


@query(
    "W6_promo_frequency",
    with_([src.PANEL, f"p AS (SELECT *, {PROMO_SQL} FROM panel)"],
          f"SELECT {KEYS}, {r('promo_frequency_7d', 'promo_frequency_7d')}, {r('promo_frequency_30d', 'promo_frequency_30d')} FROM p"),
)
def w6(spark, folder):
    df = features.add_promotions(src.panel(spark, folder))
    return rounded(df.select(*ID, "promo_frequency_7d", "promo_frequency_30d"))


@query("W7_rows_since_promo", with_([src.PANEL, NUMBERED, f"p AS (SELECT *, {run_sql()} FROM numbered)"],
                                    f"SELECT {KEYS}, days_since_promo FROM p"))
def w7(spark, folder):
    return rounded(features.add_promo_runs(src.panel(spark, folder)).select(*ID, "days_since_promo"))


@query("W8_promo_streak", with_([src.PANEL, NUMBERED, f"p AS (SELECT *, {run_sql()} FROM numbered)"],
                                f"SELECT {KEYS}, promo_streak FROM p"))
def w8(spark, folder):
    return rounded(features.add_promo_runs(src.panel(spark, folder)).select(*ID, "promo_streak"))


@query(
    "W7_W8_any_positive_promo",
    with_([src.PANEL, NUMBERED, f"p AS (SELECT *, {run_sql('onpromotion > 0')} FROM numbered)"],
          f"SELECT {KEYS}, days_since_promo, promo_streak FROM p"),
)
def w78(spark, folder):
    df = features.add_promo_runs(src.panel(spark, folder), any_positive=True)
    return rounded(df.select(*ID, "days_since_promo", "promo_streak"))


@query("W9_promo_neighbours", with_([src.PANEL, f"p AS (SELECT *, {PROMO_SQL} FROM panel)"],
                                    f"SELECT {KEYS}, promo_next_day, promo_prev_day FROM p"))
def w9(spark, folder):
    return rounded(features.add_promotions(src.panel(spark, folder)).select(*ID, "promo_next_day", "promo_prev_day"))


# external tables


def fill_both(c, order):
    return (
        f"COALESCE(last_value({c} IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" first_value({c} IGNORE NULLS) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


def full_sql(fn, c, n, order, name):
    frame = f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({c}) {frame} = {n} THEN {fn}({c}) {frame} END AS {name}"


OIL_NAMES = [
    "dcoilwtico", "oil_price_lag_1", "oil_price_lag_7", "oil_price_change", "oil_price_change_pct",
    "oil_price_ma_7", "oil_price_ma_30", "oil_volatility_7",
]
OIL_FEATURES = f"""oil0 AS (SELECT date, {fill_both('dcoilwtico', 'ORDER BY date')} FROM oil),
oil1 AS (SELECT date, dcoilwtico, lag(dcoilwtico, 1) OVER (ORDER BY date) AS oil_price_lag_1,
  lag(dcoilwtico, 7) OVER (ORDER BY date) AS oil_price_lag_7,
  dcoilwtico - lag(dcoilwtico, 1) OVER (ORDER BY date) AS oil_price_change,
  dcoilwtico / NULLIF(lag(dcoilwtico, 1) OVER (ORDER BY date), 0) - 1 AS oil_price_change_pct,
  {full_sql('AVG', 'dcoilwtico', 7, 'ORDER BY date', 'oil_price_ma_7')},
  {full_sql('AVG', 'dcoilwtico', 30, 'ORDER BY date', 'oil_price_ma_30')},
  {full_sql('STDDEV_SAMP', 'dcoilwtico', 7, 'ORDER BY date', 'oil_volatility_7')} FROM oil0),
oilf AS (SELECT date, {', '.join(fill_both(c, 'ORDER BY date') for c in OIL_NAMES)} FROM oil1)"""

OIL_OUT = ", ".join(r(c, c) for c in OIL_NAMES)


@query("W10_index_features", with_([src.OIL, OIL_FEATURES], f"SELECT date, {OIL_OUT} FROM oilf"))
def w10(spark, folder):
    return rounded(external.index_features(src.oil(spark, folder)))


T_NAMES = ["transactions", "transactions_lag_1", "transactions_lag_7", "transactions_ma_7", "transactions_ma_30",
           "transactions_growth"]
BY_STORE = "PARTITION BY store_nbr ORDER BY date"
T_FEATURES = f"""t1 AS (SELECT date, store_nbr, transactions,
  lag(transactions, 1) OVER ({BY_STORE}) AS transactions_lag_1, lag(transactions, 7) OVER ({BY_STORE}) AS transactions_lag_7,
  {full_sql('AVG', 'transactions', 7, BY_STORE, 'transactions_ma_7')},
  {full_sql('AVG', 'transactions', 30, BY_STORE, 'transactions_ma_30')},
  transactions / NULLIF(lag(transactions, 1) OVER ({BY_STORE}), 0) - 1 AS transactions_growth FROM transactions),
tf AS (SELECT date, store_nbr, {', '.join(
    f"COALESCE(last_value({c} IGNORE NULLS) OVER ({BY_STORE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
    for c in T_NAMES)} FROM t1)"""
T_OUT = ", ".join(r(c, c) for c in T_NAMES)


@query(
    "W11_transaction_features",
    with_([src.PANEL, src.TRANSACTIONS, T_FEATURES], f"SELECT date, {b('store_nbr', 'store_nbr')}, {T_OUT} FROM tf"),
)
def w11(spark, folder):
    return rounded(external.transaction_features(src.transactions(spark, folder)))


HOLIDAYS_BY_DATE = """holf AS (
  SELECT date, array_to_string(list_sort(list(DISTINCT type)), ';') AS holiday_type,
         array_to_string(list_sort(list(DISTINCT locale)), ';') AS holiday_locale,
         CAST(bool_or(transferred) AS BIGINT) AS is_transferred, CAST(1 AS BIGINT) AS is_holiday
  FROM holidays GROUP BY 1)"""


@query(
    "X1_holidays_by_date",
    with_([src.HOLIDAYS, HOLIDAYS_BY_DATE], "SELECT date, holiday_type, holiday_locale, is_transferred, is_holiday FROM holf"),
)
def x1(spark, folder):
    return rounded(external.holidays_by_date(src.holidays(spark, folder)))


DISTANCES = """dist AS (
  SELECT d.date, CAST(LEAST(365, COALESCE(MIN(CASE WHEN h.date > d.date THEN h.date - d.date END), 365)) AS BIGINT) AS days_to_holiday,
         CAST(LEAST(365, COALESCE(MIN(CASE WHEN h.date < d.date THEN d.date - h.date END), 365)) AS BIGINT) AS days_from_holiday
  FROM (SELECT DISTINCT date FROM panel) d, (SELECT DISTINCT date FROM holidays) h GROUP BY 1)"""


@query("J1_panel_with_index", with_([src.PANEL, src.OIL, OIL_FEATURES],
                                    f"SELECT {KEYS}, {OIL_OUT} FROM panel LEFT JOIN oilf USING (date)"))
def j1(spark, folder):
    df = external.with_index(src.panel(spark, folder), external.index_features(src.oil(spark, folder)))
    return rounded(df.select(*ID, *OIL_NAMES))


HOLIDAY_FILLS = """COALESCE(holiday_type, 'None') AS holiday_type, COALESCE(holiday_locale, 'None') AS holiday_locale,
  COALESCE(is_transferred, 0) AS is_transferred, COALESCE(is_holiday, 0) AS is_holiday"""


@query("J2_panel_with_holidays", with_([src.PANEL, src.HOLIDAYS, HOLIDAYS_BY_DATE],
                                       f"SELECT {KEYS}, {HOLIDAY_FILLS} FROM panel LEFT JOIN holf USING (date)"))
def j2(spark, folder):
    df = external.with_holidays(src.panel(spark, folder), external.holidays_by_date(src.holidays(spark, folder)))
    return rounded(df.select(*ID, "holiday_type", "holiday_locale", "is_transferred", "is_holiday"))


@query("J3_panel_with_transactions", with_([src.PANEL, src.TRANSACTIONS, T_FEATURES],
                                           f"SELECT {KEYS}, {T_OUT} FROM panel LEFT JOIN tf USING (date, store_nbr)"))
def j3(spark, folder):
    tx = external.transaction_features(src.transactions(spark, folder))
    return rounded(external.with_transactions(src.panel(spark, folder), tx).select(*ID, *T_NAMES))


@query("J4_nearest_holiday", with_([src.PANEL, src.HOLIDAYS, DISTANCES],
                                   f"SELECT {KEYS}, days_to_holiday, days_from_holiday FROM panel JOIN dist USING (date)"))
def j4(spark, folder):
    df = external.with_holiday_distances(src.panel(spark, folder), src.holidays(spark, folder))
    return rounded(df.select(*ID, "days_to_holiday", "days_from_holiday"))


@query(
    "J8_series_mean",
    with_(src.PANEL, f"SELECT {KEYS}, {r(f'AVG(sales) OVER ({SERIES})', 'store_family_mean_sales')} FROM panel"),
)
def j8(spark, folder):
    return rounded(features.add_series_mean(src.panel(spark, folder)).select(*ID, "store_family_mean_sales"))


@query(
    "J8_series_mean_from_training",
    with_(
        src.PANEL,
        f"""SELECT {KEYS}, {r('m', 'store_family_mean_sales')} FROM panel LEFT JOIN (
        SELECT store_nbr, family, AVG(sales) AS m FROM panel WHERE date <= DATE '2000-06-30' GROUP BY 1, 2)
        USING (store_nbr, family) WHERE date > DATE '2000-06-30'""",
    ),
)
def j8_train(spark, folder):
    df, edge = src.panel(spark, folder), F.lit("2000-06-30").cast("date")
    late = features.apply_series_mean(df.where(F.col("date") > edge), df.where(F.col("date") <= edge))
    return rounded(late.select(*ID, "store_family_mean_sales"))


# the whole chain

INTERACTIONS = [
    ("promo_weekend", "onpromotion * CAST(isodow(date) >= 6 AS BIGINT)"),
    ("promo_month_end", "onpromotion * CAST(date = last_day(date) AS BIGINT)"),
    ("promo_holiday", "onpromotion * COALESCE(is_holiday, 0)"),
    ("oil_weekend", "dcoilwtico * CAST(isodow(date) >= 6 AS BIGINT)"),
    ("oil_month", "dcoilwtico * month(date)"),
]
INTERACTION_OUT = ", ".join(r(e, n) if n.startswith("oil") else b(e, n) for n, e in INTERACTIONS)


@query(
    "D4_interactions",
    with_(
        [src.PANEL, src.OIL, OIL_FEATURES, src.HOLIDAYS, HOLIDAYS_BY_DATE],
        f"SELECT {KEYS}, {INTERACTION_OUT} FROM panel LEFT JOIN oilf USING (date) LEFT JOIN holf USING (date)",
    ),
)
def d4(spark, folder):
    df = external.with_day_table(src.panel(spark, folder), src.oil(spark, folder), src.holidays(spark, folder))
    df = features.add_interactions(features.add_calendar(df))
    return rounded(df.select(*ID, *[n for n, _ in INTERACTIONS]))


CHAIN = [
    src.PANEL, src.OIL, OIL_FEATURES, src.HOLIDAYS, HOLIDAYS_BY_DATE, DISTANCES, src.TRANSACTIONS, T_FEATURES, ROLL,
    f"""wide AS (SELECT *, {LAG_SQL}, {PROMO_SQL}, row_number() OVER ({BY_DATE}) AS rn,
    AVG(sales) OVER ({SERIES}) AS mean_sales FROM panel),
    runs AS (SELECT *, {run_sql()} FROM wide)""",
]
CHAIN_BODY = f"""SELECT {KEYS}, sales, onpromotion, {OIL_OUT}, {HOLIDAY_FILLS}, days_to_holiday, days_from_holiday, {T_OUT},
  {', '.join(SALES_LAGS + PROMO_LAGS)}, {ROLL_OUT}, {r('promo_frequency_7d', 'promo_frequency_7d')},
  {r('promo_frequency_30d', 'promo_frequency_30d')}, promo_next_day, promo_prev_day, days_since_promo, promo_streak,
  {r('mean_sales', 'store_family_mean_sales')}, {PARTS}, {FLAGS}, {', '.join(r(c.split(' AS ')[0], c.split(' AS ')[1]) for c in CYCLES.split(', '))}, {INTERACTION_OUT}
  FROM runs JOIN roll USING (date, store_nbr, family) LEFT JOIN oilf USING (date) LEFT JOIN holf USING (date)
  LEFT JOIN dist USING (date) LEFT JOIN tf USING (date, store_nbr)"""


@query("D5_feature_chain", with_(CHAIN, CHAIN_BODY))
def d5(spark, folder):
    return rounded(
        engineer(
            src.panel(spark, folder), src.oil(spark, folder), src.holidays(spark, folder), src.transactions(spark, folder)
        )
    )


RELEVANT = ["onpromotion", "sales_lag_1", "sales_lag_7", "sales_rolling_mean_7", "sales_rolling_mean_30"]


@query(
    "D6_feature_relevance",
    with_(
        [src.PANEL, ROLL, f"l AS (SELECT *, {LAG_SQL} FROM panel)", "x AS (SELECT * FROM l JOIN roll USING (date, store_nbr, family))"],
        " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'ABS(corr({c}, sales))', 'relevance')} FROM x" for c in RELEVANT),
    ),
)
def d6(spark, folder):
    df = features.add_rolling(features.add_lags(src.panel(spark, folder)), fill=False)
    return rounded(features.feature_relevance(df, RELEVANT))


QUANTILES = ", ".join(f"({q}, CAST({z_value((q - 0.5) / 50)!r} AS DOUBLE))" for q in range(1, 51))


@query(
    "D7_normal_quantile",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, {r('z', 'z', 9)}
    FROM lineitem LEFT JOIN (VALUES {QUANTILES}) t(q, z) ON l_quantity = q""",
)
def d7(spark, folder):
    """Quantile of each line's quantity as a share of fifty."""
    line = src.table(spark, folder, "lineitem")
    p = (F.col("l_quantity") - 0.5) / 50.0
    return rounded(line.select("l_orderkey", "l_linenumber", "l_quantity", normal_quantile(p).alias("z")), 9)


# callables on groups


CALLABLE_ROLL = [f"own_{name}" for name, _ in STATS]


@query(
    "P1_group_transform",
    with_(
        [src.PANEL, f"p AS (SELECT date, store_nbr, family, {roll_sql(windows=(30,))} FROM panel)"],
        f"SELECT {KEYS}, {', '.join(r(f'sales_rolling_{name}_30', f'own_{name}') for name, _ in STATS)} FROM p",
    ),
)
def p1(spark, folder):
    df = grouped.scan_groups(src.panel(spark, folder), ID[1:], ["date"], ["sales"], grouped.rolling("sales", 30, "own"))
    return rounded(df.select(*ID, *CALLABLE_ROLL))


@query("P2_group_apply", with_([src.PANEL, NUMBERED, f"p AS (SELECT *, {run_sql()} FROM numbered)"],
                               f"SELECT {KEYS}, days_since_promo, promo_streak FROM p"))
def p2(spark, folder):
    scan = grouped.since_event("onpromotion", "days_since_promo", "promo_streak")
    df = grouped.scan_groups(src.panel(spark, folder), ID[1:], ["date"], ["onpromotion"], scan)
    return rounded(df.select(*ID, "days_since_promo", "promo_streak"))


@query("P3_group_aggregate", with_([src.HOLIDAYS, HOLIDAYS_BY_DATE],
                                   "SELECT date, holiday_type, holiday_locale, is_transferred FROM holf"))
def p3(spark, folder):
    agg = grouped.joined_values({"type": "holiday_type", "locale": "holiday_locale"}, {"transferred": "is_transferred"})
    return rounded(grouped.aggregate_groups(src.holidays(spark, folder), ["date"], ["type", "locale", "transferred"], agg))
