"""Forecast accuracy and residual test queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import BY_DATE, KEYS, b, r, with_
from shelfcast.operators import evaluation

ORDER = ["date", "store_nbr", "family"]

DIRTY = """dirty AS (
  SELECT date, store_nbr, family, CASE WHEN onpromotion >= 2 THEN CAST('nan' AS DOUBLE) ELSE actual END AS actual,
         CASE WHEN day(date) = 31 THEN CAST('inf' AS DOUBLE) ELSE predicted END AS predicted
  FROM predictions JOIN panel USING (date, store_nbr, family))"""


@query(
    "E1_usable_pairs",
    with_(
        [src.PANEL, src.PREDICTIONS, DIRTY],
        f"SELECT {KEYS}, actual, predicted FROM dirty WHERE NOT isnan(actual) AND NOT isinf(predicted)",
    ),
)
def e1(spark, folder):
    w = Window.partitionBy("store_nbr", "family").orderBy("date")
    pairs = src.panel(spark, folder).select(
        *ORDER,
        F.when(F.col("onpromotion") >= 2, F.lit(float("nan"))).otherwise(F.col("sales")).alias("actual"),
        F.lag("sales", 7).over(w).alias("predicted"),
    )
    broken = pairs.withColumn(
        "predicted", F.when(F.dayofmonth("date") == 31, F.lit(float("inf"))).otherwise(F.col("predicted"))
    )
    return rounded(evaluation.usable_pairs(broken))


ACC = {
    "mae": "AVG(ABS(actual - predicted))",
    "rmse": "sqrt(AVG((actual - predicted) * (actual - predicted)))",
    "mbe": "AVG(predicted - actual)",
    "mape": "AVG(ABS(actual - predicted) / NULLIF(ABS(actual), 0)) * 100",
    "wmape": "SUM(ABS(actual - predicted)) / NULLIF(SUM(ABS(actual)), 0) * 100",
    "smape": "AVG(ABS(actual - predicted) / NULLIF((ABS(actual) + ABS(predicted)) / 2, 0)) * 100",
    "r2": "1 - SUM((actual - predicted) * (actual - predicted)) / NULLIF(VAR_POP(actual) * COUNT(*), 0)",
}


def acc_sql(names):
    return "SELECT COUNT(*) AS n, " + ", ".join(r(ACC[m], m) for m in names) + " FROM predictions"


def _register(name, metrics):
    @query(name, with_([src.PANEL, src.PREDICTIONS], acc_sql(metrics)))
    def run(spark, folder):
        return rounded(evaluation.accuracy(src.predictions(spark, folder), metrics))

    return run


_register("E2_mae_rmse_mbe", ("mae", "rmse", "mbe"))
_register("E3_mape", ("mape",))
_register("E4_wmape", ("wmape",))
_register("E5_smape", ("smape",))
_register("E6_r2", ("r2",))


@query(
    "E2_accuracy_by_series",
    with_(
        [src.PANEL, src.PREDICTIONS],
        f"SELECT {b('store_nbr', 'store_nbr')}, family, COUNT(*) AS n, "
        + ", ".join(r(e, m) for m, e in ACC.items())
        + " FROM predictions GROUP BY store_nbr, family",
    ),
)
def e2_series(spark, folder):
    return rounded(evaluation.accuracy(src.predictions(spark, folder), by=["store_nbr", "family"]))


def steps(window):
    return f"""steps AS (SELECT actual, predicted, actual - lag(actual) OVER ({window}) AS ys,
    predicted - lag(predicted) OVER ({window}) AS ps FROM predictions)"""


SEQUENCE = f"""SELECT COUNT(*) AS n, {r('AVG(ABS(actual - predicted)) / NULLIF(AVG(ABS(ys)), 0)', 'mase')},
  {r('100.0 * AVG(CASE WHEN ys IS NOT NULL THEN CASE WHEN (ys > 0) = (ps > 0) THEN 1.0 ELSE 0.0 END END)', 'directional_accuracy')}
  FROM steps"""


@query("E7_E8_mase_direction_by_series", with_([src.PANEL, src.PREDICTIONS, steps(BY_DATE)], SEQUENCE))
def e78(spark, folder):
    return rounded(evaluation.sequence_metrics(src.predictions(spark, folder)))


@query("E7_mase", with_([src.PANEL, src.PREDICTIONS, steps("ORDER BY date, store_nbr, family")],
                        f"SELECT n, mase FROM ({SEQUENCE})"))
def e7(spark, folder):
    return rounded(evaluation.sequence_metrics(src.predictions(spark, folder), ORDER)).select("n", "mase")


@query("E8_directional_accuracy", with_([src.PANEL, src.PREDICTIONS, steps("ORDER BY date, store_nbr, family")],
                                        f"SELECT n, directional_accuracy FROM ({SEQUENCE})"))
def e8(spark, folder):
    return rounded(evaluation.sequence_metrics(src.predictions(spark, folder), ORDER)).select("n", "directional_accuracy")


@query("E9_model_metrics", with_([src.PANEL, src.PREDICTIONS], acc_sql(("mae", "rmse", "mape", "wmape", "r2"))))
def e9(spark, folder):
    return rounded(evaluation.model_metrics(src.predictions(spark, folder)))


# population skewness and kurtosis from central moments
PROFILE = """prof AS (
  SELECT COUNT(*) AS n, AVG(e) AS mean_residual, STDDEV_POP(e) AS std_residual,
         AVG(pow(e - m, 3)) / pow(STDDEV_POP(e), 3) AS skewness, AVG(pow(e - m, 4)) / pow(STDDEV_POP(e), 4) - 3 AS kurtosis
  FROM (SELECT predicted - actual AS e, AVG(predicted - actual) OVER () AS m FROM predictions))"""


@query(
    "E10_residual_profile",
    with_([src.PANEL, src.PREDICTIONS, PROFILE],
          "SELECT n, " + ", ".join(r(c, c) for c in ("mean_residual", "std_residual", "skewness", "kurtosis")) + " FROM prof"),
)
def e10(spark, folder):
    return rounded(evaluation.residual_profile(src.predictions(spark, folder)))


def box_sql(window):
    lags = ", ".join(f"lag(e, {k}) OVER ({window}) AS e{k}" for k in range(1, 11))
    sums = ", ".join(f"SUM(e * e{k}) AS c{k}" for k in range(1, 11))
    total = " + ".join(f"pow(c{k} / v, 2) / (n - {k})" for k in range(1, 11))
    return f"""cent AS (SELECT date, store_nbr, family,
      predicted - actual - AVG(predicted - actual) OVER () AS e FROM predictions),
    lagged AS (SELECT e, {lags} FROM cent),
    sums AS (SELECT COUNT(*) AS n, SUM(e * e) AS v, {sums} FROM lagged),
    box AS (SELECT n, CAST(n AS DOUBLE) * (n + 2) * ({total}) AS q FROM sums)"""


def p_sql(x="q"):
    terms = " + ".join(f"pow({x} / 2, {k}) / {f}" for k, f in ((1, 1), (2, 2), (3, 6), (4, 24)))
    return f"exp(-{x} / 2) * (1 + {terms})"


@query(
    "E11_ljung_box",
    with_([src.PANEL, src.PREDICTIONS, box_sql("ORDER BY date, store_nbr, family")],
          f"SELECT n, {r('q', 'statistic')}, {r(p_sql(), 'p_value')} FROM box"),
)
def e11(spark, folder):
    return rounded(evaluation.ljung_box(src.predictions(spark, folder), ORDER))


@query(
    "E11_ljung_box_by_series_order",
    with_([src.PANEL, src.PREDICTIONS, box_sql(BY_DATE)], f"SELECT n, {r('q', 'statistic')}, {r(p_sql(), 'p_value')} FROM box"),
)
def e11_series(spark, folder):
    return rounded(evaluation.ljung_box(src.predictions(spark, folder)))


@query(
    "E12_jarque_bera",
    with_(
        [src.PANEL, src.PREDICTIONS, PROFILE],
        f"""SELECT n, {r('n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4)', 'statistic')},
        {r('exp(-n / 12.0 * (skewness * skewness + kurtosis * kurtosis / 4))', 'p_value')} FROM prof""",
    ),
)
def e12(spark, folder):
    return rounded(evaluation.jarque_bera(src.predictions(spark, folder)))


@query(
    "E13_heteroscedasticity",
    with_(
        [src.PANEL, src.PREDICTIONS],
        f"""SELECT COUNT(*) AS n,
        {r('corr(predicted, (predicted - actual) * (predicted - actual))', 'correlation')} FROM predictions""",
    ),
)
def e13(spark, folder):
    return rounded(evaluation.heteroscedasticity(src.predictions(spark, folder), with_p_value=False))


def cosine_sql(low: str) -> str:
    """Simpson's rule for cos(t) ** (n - 3) from ``low`` on, in 400 steps."""
    high = f"least(pi() / 2, sqrt(({low}) * ({low}) + CAST(80 AS DOUBLE) / greatest(n - 3, 1)))"
    step = f"(({high}) - ({low})) / CAST(400 AS DOUBLE)"
    return f"""list_sum(list_transform(range(0, 401), lambda k : CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
      * pow(cos(({low}) + k * ({step})), n - 3))) * ({step}) / 3"""


@query(
    "E13_heteroscedasticity_p_value",
    with_(
        [
            src.PANEL,
            src.PREDICTIONS,
            "one AS (SELECT COUNT(*) AS n, corr(predicted, (predicted - actual) * (predicted - actual)) AS c FROM predictions)",
        ],
        f"""SELECT n, {r('c', 'correlation', 6)}, {r(f"({cosine_sql('asin(abs(c))')}) / ({cosine_sql('CAST(0 AS DOUBLE)')})", 'p_value', 6)} FROM one""",
    ),
)
def e13_p(spark, folder):
    return rounded(evaluation.heteroscedasticity(src.predictions(spark, folder)), 6)


@query(
    "E14_report_advice",
    with_(
        [src.PANEL, src.PREDICTIONS, PROFILE, box_sql("ORDER BY date, store_nbr, family")],
        f"""SELECT array_to_string(list_filter([
          CASE WHEN wmape < 10 THEN 'Excellent forecast accuracy - model is production ready'
               WHEN wmape < 20 THEN 'Good forecast accuracy - minor improvements possible'
               ELSE 'Poor forecast accuracy - model needs significant improvement' END,
          CASE WHEN r2 < 0.5 THEN 'Low R² indicates poor model fit - consider feature engineering' END,
          CASE WHEN {p_sql()} < 0.05 THEN 'Autocorrelation detected in residuals - consider time series modeling' END,
          CASE WHEN exp(-prof.n / 12.0 * (skewness * skewness + kurtosis * kurtosis / 4)) < 0.05
               THEN 'Non-normal residuals detected - check for outliers or model specification' END
        ], lambda x : x IS NOT NULL), ' | ') AS advice
        FROM (SELECT {ACC['wmape']} AS wmape, {ACC['r2']} AS r2 FROM predictions), prof, box""",
    ),
)
def e14(spark, folder):
    from shelfcast.plans.durable import durable

    pairs = durable(src.predictions(spark, folder))
    report = evaluation.evaluation_report(pairs, "seasonal naive", ORDER)
    return report.select(F.concat_ws(" | ", "recommendations").alias("advice"))


@query("X2_report_json")
def x2(spark, folder):
    from shelfcast.plans.durable import durable

    pairs = durable(src.predictions(spark, folder))
    return evaluation.report_json(evaluation.evaluation_report(pairs, "seasonal naive"))


@query(
    "X2_json_fields",
    with_(
        [src.PANEL, src.PREDICTIONS, PROFILE],
        f"""SELECT 'seasonal naive' AS model, wmape, r2, {r('n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4)', 'jarque_bera')}
        FROM prof, (SELECT {r(ACC['wmape'], 'wmape')}, {r(ACC['r2'], 'r2')} FROM predictions)""",
    ),
)
def x2_fields(spark, folder):
    """The JSON report parsed back into columns."""
    fields = F.from_json("report", "model string, wmape double, r2 double, jarque_bera double")
    return rounded(x2(spark, folder).select(fields.alias("j")).select("j.*"))


MODELS = {
    "lag 7": "lag(sales, 7)", "lag 14": "lag(sales, 14)", "lag 1": "lag(sales, 1)", "last value": "lag(sales, 1)",
}


@query(
    "W16_model_ranks",
    with_(
        [
            src.PANEL,
            "scores AS ("
            + " UNION ALL ".join(
                f"""SELECT '{m}' AS model, SUM(ABS(actual - predicted)) / SUM(ABS(actual)) * 100 AS wmape FROM
                (SELECT sales AS actual, {e} OVER ({BY_DATE}) AS predicted FROM panel) WHERE predicted IS NOT NULL"""
                for m, e in MODELS.items()
            )
            + ")",
        ],
        f"""SELECT model, {r('wmape', 'wmape')},
        rank() OVER (ORDER BY wmape) + (COUNT(*) OVER (PARTITION BY wmape) - 1) / 2.0 + CAST(0 AS DOUBLE) AS wmape_rank FROM scores""",
    ),
)
def w16(spark, folder):
    w = Window.partitionBy("store_nbr", "family").orderBy("date")
    lag = {"lag 7": 7, "lag 14": 14, "lag 1": 1, "last value": 1}
    # all models side by side: one pass over the panel, then one row per model
    lagged = src.panel(spark, folder).select(
        F.col("sales").alias("actual"), *[F.lag("sales", k).over(w).alias(m) for m, k in lag.items()]
    )
    wide = lagged.select(
        "actual", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in lag])).alias("_m")
    )
    pairs = wide.select("_m.model", "actual", F.col("_m.p").alias("predicted"))
    return rounded(evaluation.compare_models(evaluation.accuracy(pairs, ("wmape",), by=["model"])).drop("n"))
