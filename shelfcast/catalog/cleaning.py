"""Cleaning and profiling queries."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import BY_DATE, KEYS, b, r, with_
from shelfcast.operators import cleaning, features, profile

FILLED = """filled AS (
  SELECT date, store_nbr, family, sales, COALESCE(onpromotion, 0) AS onpromotion
  FROM typed WHERE date IS NOT NULL AND sales IS NOT NULL),
deduped AS (SELECT DISTINCT * FROM filled)"""


def typed(spark, folder):
    return cleaning.coerce_types(src.feed(spark, folder))


@query("C1_types", with_(src.FEED, f"SELECT {KEYS}, sales, onpromotion FROM typed"))
def c1(spark, folder):
    return rounded(typed(spark, folder))


@query("C2_missing", with_([src.FEED, FILLED], f"SELECT {KEYS}, sales, onpromotion FROM filled"))
def c2(spark, folder):
    return rounded(cleaning.fill_missing(typed(spark, folder)))


@query(
    "C2_missing_counts",
    with_(
        src.FEED,
        """SELECT COUNT(*) FILTER (sales IS NULL) AS target_missing, COUNT(*) FILTER (sales IS NULL) AS target_dropped,
        COUNT(*) FILTER (sales IS NOT NULL AND onpromotion IS NULL) AS promo_filled,
        COUNT(*) FILTER (sales IS NOT NULL AND date IS NULL) AS date_dropped,
        COUNT(*) FILTER (sales IS NOT NULL AND date IS NOT NULL) AS rows_left FROM typed""",
    ),
)
def c2_counts(spark, folder):
    return cleaning.missing_value_counts(typed(spark, folder))


@query("C3_duplicates", with_([src.FEED, FILLED], f"SELECT {KEYS}, sales, onpromotion FROM deduped"))
def c3(spark, folder):
    return rounded(cleaning.drop_duplicates(cleaning.fill_missing(typed(spark, folder))))


@query(
    "C3_duplicate_counts",
    with_(
        [src.FEED, FILLED],
        """SELECT n AS initial_count, d AS final_count, n - d AS removed_count
        FROM (SELECT (SELECT COUNT(*) FROM filled) AS n, (SELECT COUNT(*) FROM deduped) AS d)""",
    ),
)
def c3_counts(spark, folder):
    return cleaning.duplicate_counts(cleaning.fill_missing(typed(spark, folder)))


@query(
    "C3_key_duplicates",
    with_(
        [src.FEED, FILLED],
        f"""SELECT {KEYS}, sales, onpromotion FROM filled QUALIFY row_number() OVER (
        PARTITION BY date, store_nbr, family ORDER BY onpromotion NULLS FIRST, sales NULLS FIRST) = 1""",
    ),
)
def c3_keys(spark, folder):
    rows = cleaning.fill_missing(typed(spark, folder))
    return rounded(cleaning.drop_duplicates(rows, ["date", "store_nbr", "family"], order=["onpromotion"]))


IQR = f"""limits AS (
  SELECT store_nbr, family, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3,
         quantile_cont(sales, 0.99) AS p99, AVG(sales) AS mean, STDDEV_POP(sales) AS std
  FROM panel GROUP BY 1, 2),
iqr AS (
  SELECT p.*, p99, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
         sales < q1 - 1.5 * (q3 - q1) OR sales > q3 + 1.5 * (q3 - q1) AS is_outlier
  FROM panel p JOIN limits l ON p.store_nbr = l.store_nbr AND p.family = l.family),
zs AS (
  SELECT p.*, p99, COALESCE(ABS(sales - mean) / NULLIF(std, 0) > 3, false) AS is_outlier
  FROM panel p JOIN limits l ON p.store_nbr = l.store_nbr AND p.family = l.family)"""


@query("C4_iqr_flags", with_([src.PANEL, IQR], f"SELECT {KEYS}, {r('sales', 'sales')}, {r('p99', 'p99')}, is_outlier FROM iqr"))
def c4(spark, folder):
    flagged = cleaning.flag_outliers(src.panel(spark, folder), "iqr")
    return rounded(flagged.select("date", "store_nbr", "family", "sales", "p99", "is_outlier"))


@query("C5_zscore_flags", with_([src.PANEL, IQR], f"SELECT {KEYS}, {r('sales', 'sales')}, is_outlier FROM zs"))
def c5(spark, folder):
    flagged = cleaning.flag_outliers(src.panel(spark, folder), "zscore")
    return rounded(flagged.select("date", "store_nbr", "family", "sales", "is_outlier"))


@query(
    "C6_outliers_replaced",
    with_([src.PANEL, IQR], f"SELECT {KEYS}, {r('CASE WHEN is_outlier THEN p99 ELSE sales END', 'sales')}, onpromotion FROM iqr"),
)
def c6(spark, folder):
    return rounded(cleaning.replace_outliers(src.panel(spark, folder)))


@query(
    "C6_outliers_clipped",
    with_([src.PANEL, IQR], f"SELECT {KEYS}, {r('greatest(lo, least(hi, sales))', 'sales')}, onpromotion FROM iqr"),
)
def c6_clip(spark, folder):
    return rounded(cleaning.replace_outliers(src.panel(spark, folder), mode="clip"))


@query(
    "C6_outlier_counts",
    with_(
        [src.PANEL, IQR],
        f"""SELECT COUNT(*) FILTER (is_outlier) AS total_outliers,
        {r('100.0 * COUNT(*) FILTER (is_outlier) / COUNT(*)', 'outlier_percentage')} FROM iqr""",
    ),
)
def c6_counts(spark, folder):
    return rounded(cleaning.outlier_counts(cleaning.flag_outliers(src.panel(spark, folder))))


@query(
    "C7_consistency",
    with_(
        [src.FEED, FILLED],
        f"""SELECT COUNT(*) AS rows, COUNT(*) FILTER (sales < 0) AS negative_count,
        {r('100.0 * COUNT(*) FILTER (sales < 0) / COUNT(*)', 'negative_percentage')},
        COUNT(*) - (SELECT COUNT(*) FROM deduped) AS duplicate_count,
        {r('100.0 * (COUNT(*) - (SELECT COUNT(*) FROM deduped)) / COUNT(*)', 'duplicate_percentage')},
        MIN(date) AS date_min, MAX(date) AS date_max, {b('MAX(date) - MIN(date)', 'total_days')},
        {b('MAX(date) - MIN(date) + 1 - COUNT(DISTINCT date)', 'missing_dates_count')},
        COUNT(DISTINCT store_nbr) AS store_count, COUNT(DISTINCT family) AS family_count FROM filled""",
    ),
)
def c7(spark, folder):
    return rounded(profile.consistency_checks(cleaning.fill_missing(typed(spark, folder))))


@query(
    "C8_gap_summary",
    with_(
        src.OIL,
        f"""SELECT {b('MAX(date) - MIN(date) + 1 - COUNT(DISTINCT date)', 'missing_dates_count')},
        {r('100.0 * (MAX(date) - MIN(date) + 1 - COUNT(DISTINCT date)) / (MAX(date) - MIN(date) + 1)',
           'missing_dates_percentage')} FROM oil""",
    ),
)
def c8(spark, folder):
    return rounded(profile.gap_summary(src.oil(spark, folder)))


@query(
    "C8_series_gaps",
    with_(
        src.PANEL,
        """SELECT CAST(store_nbr AS BIGINT) AS store_nbr, family, COUNT(*) AS missing_days, MIN(date) AS first_gap,
        MAX(date) AS last_gap FROM (
          SELECT store_nbr, family, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM panel GROUP BY 1, 2 EXCEPT SELECT store_nbr, family, date FROM panel) GROUP BY 1, 2""",
    ),
)
def c8_series(spark, folder):
    gaps = profile.calendar_gaps(src.panel(spark, folder), keys=["store_nbr", "family"])
    return rounded(
        gaps.groupBy("store_nbr", "family").agg(
            F.count(F.lit(1)).alias("missing_days"), F.min("date").alias("first_gap"), F.max("date").alias("last_gap")
        )
    )


@query("C9_sorted_panel", with_(src.PANEL, f"SELECT {KEYS}, {r('sales', 'sales')}, onpromotion FROM panel ORDER BY 1, 2, 3"))
def c9(spark, folder):
    return rounded(cleaning.sort_panel(src.panel(spark, folder)))


@query(
    "C10_cleaned",
    with_(
        [
            src.FEED,
            FILLED,
            """lim AS (SELECT store_nbr, family, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3,
            quantile_cont(sales, 0.99) AS p99 FROM deduped GROUP BY 1, 2)""",
        ],
        f"""SELECT d.date, CAST(d.store_nbr AS BIGINT) AS store_nbr, d.family,
        {r('CASE WHEN sales < q1 - 1.5 * (q3 - q1) OR sales > q3 + 1.5 * (q3 - q1) THEN p99 ELSE sales END', 'sales')},
        onpromotion FROM deduped d JOIN lim l ON d.store_nbr = l.store_nbr AND d.family = l.family""",
    ),
)
def c10(spark, folder):
    from shelfcast.plans.cleaning import clean

    return rounded(clean(src.feed(spark, folder)))


@query(
    "C11_quality",
    with_(
        src.FEED,
        f"""SELECT *, nulls_date + nulls_store_nbr + nulls_family + nulls_sales + nulls_onpromotion AS missing_total,
        {r('100.0 * (nulls_date + nulls_store_nbr + nulls_family + nulls_sales + nulls_onpromotion) / (rows * 5)',
           'missing_percentage')},
        {r('100.0 * duplicate_rows / rows', 'duplicate_percentage')} FROM (
        SELECT COUNT(*) AS rows, CAST(5 AS BIGINT) AS columns, COUNT(*) - COUNT(date) AS nulls_date,
        COUNT(*) - COUNT(store_nbr) AS nulls_store_nbr, COUNT(*) - COUNT(family) AS nulls_family,
        COUNT(*) - COUNT(sales) AS nulls_sales, COUNT(*) - COUNT(onpromotion) AS nulls_onpromotion,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM typed)) AS duplicate_rows FROM typed)""",
    ),
)
def c11(spark, folder):
    return rounded(profile.quality_report(typed(spark, folder)))


@query(
    "C12_target_profile",
    with_(
        src.PANEL,
        f"""SELECT {r('AVG(sales)', 'mean')}, {r('STDDEV_SAMP(sales)', 'std')}, MIN(sales) AS min, MAX(sales) AS max,
        {r('skewness(sales)', 'skewness')}, {r('kurtosis(sales)', 'kurtosis')},
        {r('quantile_cont(sales, 0.5)', 'median')} FROM panel""",
    ),
)
def c12(spark, folder):
    return rounded(profile.target_profile(src.panel(spark, folder)))


@query(
    "C13_categories",
    with_(
        [
            src.PANEL,
            """v AS (SELECT 'store_nbr' AS "column", CAST(store_nbr AS VARCHAR) AS value FROM panel
            UNION ALL SELECT 'family', family FROM panel),
            c AS (SELECT "column", value, COUNT(*) AS n FROM v GROUP BY 1, 2)""",
        ],
        """SELECT "column", COUNT(*) AS distinct_count, arg_min(value, struct_pack(a := -n, b := value)) AS most_common,
        MAX(n) AS most_common_count FROM c GROUP BY 1""",
    ),
)
def c13(spark, folder):
    return profile.categorical_profile(src.panel(spark, folder), ["store_nbr", "family"])


@query(
    "C14_input_checks",
    with_(
        src.PANEL,
        """SELECT COUNT(*) AS rows, COUNT(*) FILTER (isinf(inverse)) AS infinite_inverse,
        CAST(0 AS BIGINT) AS infinite_sales FROM (
        SELECT sales, CASE WHEN onpromotion = 0 THEN CAST('inf' AS DOUBLE) ELSE sales / onpromotion END AS inverse FROM panel)""",
    ),
)
def c14(spark, folder):
    inverse = F.when(F.col("onpromotion") == 0, F.lit(float("inf"))).otherwise(F.col("sales") / F.col("onpromotion"))
    return profile.input_checks(src.panel(spark, folder).withColumn("inverse", inverse), ["inverse", "sales"])


MODEL_INPUT = f"""wide AS (
  SELECT *, CAST(month(date) AS BIGINT) AS month, isodow(date) >= 6 AS is_weekend,
         lag(sales, 7) OVER ({BY_DATE}) AS sales_lag_7, lag(sales, 30) OVER ({BY_DATE}) AS sales_lag_30 FROM panel)"""


def wide(spark, folder):
    df = features.add_lags(src.panel(spark, folder), lags=(7, 30), promo_lags=())
    d = F.col("date")
    return df.withColumns({"month": F.month(d), "is_weekend": F.weekday(d) >= 5})


@query(
    "C17_feature_columns",
    with_([src.PANEL, MODEL_INPUT], "SELECT onpromotion, sales_lag_7, sales_lag_30, month FROM wide"),
)
def c17(spark, folder):
    df = wide(spark, folder)
    return rounded(df.select(*profile.feature_columns(df)))


@query(
    "C18_aligned_columns",
    with_(
        [src.PANEL, MODEL_INPUT],
        f"SELECT {KEYS}, month, CAST(0 AS DOUBLE) AS oil_price_ma_7, sales_lag_7 FROM wide",
    ),
)
def c18(spark, folder):
    return rounded(
        profile.align_columns(
            wide(spark, folder), ["month", "oil_price_ma_7", "sales_lag_7"], ["date", "store_nbr", "family"]
        )
    )


FILL = "COALESCE(last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), " \
       "first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"


@query(
    "C19_filled_features",
    with_(
        [src.PANEL, MODEL_INPUT],
        f"SELECT {KEYS}, {FILL.format(c='sales_lag_7', w=BY_DATE)}, {FILL.format(c='sales_lag_30', w=BY_DATE)} FROM wide",
    ),
)
def c19(spark, folder):
    filled = cleaning.fill_features(wide(spark, folder), ["sales_lag_7", "sales_lag_30"])
    return rounded(filled.select("date", "store_nbr", "family", "sales_lag_7", "sales_lag_30"))


@query(
    "U2_missing_dates",
    with_(
        [src.PANEL, src.OIL],
        "SELECT DISTINCT date FROM panel WHERE date NOT IN (SELECT date FROM oil)",
    ),
)
def u2(spark, folder):
    return profile.missing_dates(src.panel(spark, folder), src.oil(spark, folder))
