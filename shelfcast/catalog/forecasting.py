"""Split, model and forecast queries."""

from pyspark.sql import functions as F

from shelfcast.catalog import inputs as src
from shelfcast.catalog.inputs import rounded
from shelfcast.catalog.registry import query
from shelfcast.catalog.sqltext import BY_DATE, KEYS, b, r, with_
from shelfcast.functions.stats import z_value
from shelfcast.operators import bands, features
from shelfcast.plans import training
from shelfcast.plans.durable import durable
from shelfcast.plans.folds import label_slices
from shelfcast.plans.forecasting import forecast, forecast_from_state
from shelfcast.plans.state import advance, features_from_state, series_state

SERIES = ["store_nbr", "family"]


@query(
    "F1_chronological_split",
    with_(
        [
            src.PANEL,
            """days AS (SELECT date, COUNT(*) AS c FROM panel GROUP BY 1),
            run AS (SELECT date, SUM(c) OVER (ORDER BY date) AS upto, SUM(c) OVER () AS n FROM days),
            cut AS (SELECT MIN(date) AS d FROM run WHERE upto > floor(CAST(0.8 AS DOUBLE) * n))""",
        ],
        """SELECT CASE WHEN date <= d THEN 'train' ELSE 'holdout' END AS slice, COUNT(*) AS rows, MIN(date) AS first_date,
        MAX(date) AS last_date FROM panel, cut GROUP BY 1""",
    ),
)
def f1(spark, folder):
    return label_slices(src.panel(spark, folder)).groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


MEAN_BACKTEST = with_(
    [
        src.PANEL,
        """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS u FROM (SELECT DISTINCT date FROM panel)),
        pos AS (SELECT DISTINCT CAST(trunc(trunc(u * 0.5) + k * ((u - 31) - trunc(u * 0.5)) / 4.0) AS BIGINT) AS c, u
                FROM (SELECT MAX(u) AS u FROM days), (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
        folds AS (SELECT row_number() OVER (ORDER BY c) AS fold, a.date AS cutoff, e.date AS test_end
                  FROM pos JOIN days a ON a.i = c JOIN days e ON e.i = least(c + 30, pos.u - 1)),
        means AS (SELECT fold, store_nbr, family, AVG(sales) AS m, COUNT(*) AS n FROM folds JOIN panel ON date <= cutoff GROUP BY 1, 2, 3),
        tested AS (SELECT f.fold, cutoff, sales, greatest(COALESCE(m, 0), 0) AS m FROM folds f
                   JOIN panel p ON p.date > cutoff AND p.date <= test_end
                   LEFT JOIN means q ON q.fold = f.fold AND q.store_nbr = p.store_nbr AND q.family = p.family)""",
    ],
    """SELECT fold, cutoff, (SELECT CAST(SUM(n) AS BIGINT) FROM means x WHERE x.fold = t.fold) AS n_train, COUNT(*) AS n_test,
    round(SUM(ABS(sales - m)) / greatest(SUM(ABS(sales)), 1e-9) * 100, 3) AS wmape,
    round(AVG(ABS(sales - m)), 3) AS mae FROM tested t GROUP BY fold, cutoff""",
)


@query(
    "F12_backtest_of_series_mean",
    MEAN_BACKTEST,
)
def f12(spark, folder):
    return rounded(training.mean_backtest(durable(src.panel(spark, folder))), 3)


@query("P4_backtest_of_given_model", MEAN_BACKTEST)
def p4(spark, folder):
    """The rolling backtest with an Estimator of the caller's own, which has the same SQL as the mean's."""
    rows = durable(src.panel(spark, folder)).withColumn("label", F.col("sales").cast("double"))
    return rounded(training.rolling_backtest(rows, training.SeriesMean), 3)


# bands and ensembles on the seven-row-lag prediction

HELD = """held AS (SELECT *, predicted AS prediction, actual - predicted AS residual FROM predictions),
offs AS (SELECT store_nbr, family, quantile_cont(residual, 0.1) AS r10, quantile_cont(residual, 0.5) AS r50,
  quantile_cont(residual, 0.9) AS r90 FROM held GROUP BY 1, 2)"""


def held(spark, folder):
    return src.predictions(spark, folder).select(
        "date", *SERIES, F.col("predicted").alias("prediction"), (F.col("actual") - F.col("predicted")).alias("residual")
    )


@query("F4_points_clipped", with_([src.PANEL, src.PREDICTIONS, HELD],
                                  f"SELECT {KEYS}, {r('greatest(residual, 0)', 'residual')} FROM held"))
def f4(spark, folder):
    return rounded(bands.clip_points(held(spark, folder), "residual").drop("prediction"))


@query(
    "F5_residual_offsets",
    with_([src.PANEL, src.PREDICTIONS, HELD],
          f"SELECT {b('store_nbr', 'store_nbr')}, family, {r('r10', 'r10')}, {r('r50', 'r50')}, {r('r90', 'r90')} FROM offs"),
)
def f5(spark, folder):
    return rounded(bands.residual_offsets(held(spark, folder), SERIES))


POOLS = """known AS (SELECT * FROM held WHERE family <> 'SMALL' AND store_nbr <> 3),
series_offs AS (SELECT store_nbr, family, quantile_cont(residual, 0.1) AS r10, quantile_cont(residual, 0.5) AS r50,
  quantile_cont(residual, 0.9) AS r90 FROM known GROUP BY 1, 2 HAVING COUNT(residual) >= 30),
group_offs AS (SELECT store_nbr, quantile_cont(residual, 0.1) AS r10, quantile_cont(residual, 0.5) AS r50,
  quantile_cont(residual, 0.9) AS r90 FROM known GROUP BY 1),
all_offs AS (SELECT quantile_cont(residual, 0.1) AS r10, quantile_cont(residual, 0.5) AS r50,
  quantile_cont(residual, 0.9) AS r90 FROM known),
chosen AS (SELECT h.*, COALESCE(s.r10, g.r10, a.r10) AS r10, COALESCE(s.r50, g.r50, a.r50) AS r50,
  COALESCE(s.r90, g.r90, a.r90) AS r90,
  CASE WHEN s.r10 IS NOT NULL THEN 'series' WHEN g.r10 IS NOT NULL THEN 'group' ELSE 'all' END AS level
  FROM held h LEFT JOIN series_offs s ON h.store_nbr = s.store_nbr AND h.family = s.family
  LEFT JOIN group_offs g ON h.store_nbr = g.store_nbr, all_offs a)"""

QUANTILE_SQL = ", ".join(
    r(f"list_sort([greatest(prediction + r10, 0), greatest(prediction + r50, 0), greatest(prediction + r90, 0)])[{i}]", c)
    for i, c in enumerate(bands.QUANTILES, 1)
)


@query("F6_quantile_forecast", with_([src.PANEL, src.PREDICTIONS, HELD, POOLS], f"SELECT {KEYS}, {QUANTILE_SQL}, level FROM chosen"))
def f6(spark, folder):
    """One family and one store are left out of the calibration, so all three levels occur."""
    df = held(spark, folder)
    known = durable(df.where("family <> 'SMALL' AND store_nbr <> 3"))
    out = bands.residual_quantiles(df, durable(bands.pooled_offsets(known, SERIES)), SERIES)
    return rounded(out.select("date", *SERIES, *bands.QUANTILES, "level"))


@query(
    "F7_interval",
    with_(
        [src.PANEL, src.PREDICTIONS, HELD],
        f"""SELECT {KEYS}, {r(f'greatest(prediction - CAST({z_value(0.95)!r} AS DOUBLE) * s, 0)', 'lower')},
        {r(f'prediction + CAST({z_value(0.95)!r} AS DOUBLE) * s', 'upper')}
        FROM (SELECT *, STDDEV_POP(prediction) OVER () * 0.1 AS s FROM held)""",
    ),
)
def f7(spark, folder):
    df = bands.normal_interval(held(spark, folder), 0.90)
    return rounded(df.select("date", *SERIES, "lower", "upper"))


@query(
    "F7_interval_from_residuals",
    with_(
        [src.PANEL, src.PREDICTIONS, HELD],
        f"""SELECT {KEYS}, {r(f'greatest(prediction - CAST({z_value(0.975)!r} AS DOUBLE) * s, 0)', 'lower')},
        {r(f'prediction + CAST({z_value(0.975)!r} AS DOUBLE) * s', 'upper')}
        FROM (SELECT *, STDDEV_POP(residual) OVER () AS s FROM held)""",
    ),
)
def f7_residual(spark, folder):
    df = held(spark, folder)
    df = bands.normal_interval(df, 0.95, df.agg(F.stddev_pop("residual")).scalar())
    return rounded(df.select("date", *SERIES, "lower", "upper"))


@query("F8_heuristic_band", with_([src.PANEL, src.PREDICTIONS, HELD],
                                  f"SELECT {KEYS}, {r('prediction * 0.9', 'lower')}, {r('prediction * 1.1', 'upper')} FROM held"))
def f8(spark, folder):
    return rounded(bands.heuristic_band(held(spark, folder)).select("date", *SERIES, "lower", "upper"))


MEMBERS = f"""two AS (SELECT date, store_nbr, family, lag(sales, 7) OVER ({BY_DATE}) AS a, lag(sales, 14) OVER ({BY_DATE}) AS b FROM panel)"""


def members(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy(*SERIES).orderBy("date")
    df = src.panel(spark, folder).select(
        "date", *SERIES, F.lag("sales", 7).over(w).alias("a"), F.lag("sales", 14).over(w).alias("b")
    ).where(F.col("b").isNotNull())
    return df


@query("F9_ensemble_points", with_([src.PANEL, MEMBERS], f"SELECT {KEYS}, {r('greatest(a * 0.75 + b * 0.25, 0)', 'prediction')} FROM two WHERE b IS NOT NULL"))
def f9(spark, folder):
    df, keys = members(spark, folder), ["date", *SERIES]
    parts = {n: df.select(*keys, F.col(n).alias("prediction")) for n in "ab"}
    return rounded(bands.combine(parts, keys, {"a": 3.0}))


@query(
    "F9_ensemble_quantiles",
    with_(
        [src.PANEL, MEMBERS],
        f"""SELECT {KEYS}, """
        + ", ".join(
            r(
                f"""list_sort([greatest((a * 0.8 + b * 1.2) / 2, 0), greatest((a + b) / 2, 0),
                greatest((a * 1.3 + b * 0.9) / 2, 0)])[{i}]""",
                c,
            )
            for i, c in enumerate(bands.QUANTILES, 1)
        )
        + " FROM two WHERE b IS NOT NULL",
    ),
)
def f9_quantiles(spark, folder):
    df, keys = members(spark, folder), ["date", *SERIES]
    shape = {"a": (0.8, 1.0, 1.3), "b": (1.2, 1.0, 0.9)}
    parts = {
        n: df.select(*keys, *[(F.col(n) * F.lit(k)).alias(c) for k, c in zip(shape[n], bands.QUANTILES)]) for n in "ab"
    }
    return rounded(bands.combine(parts, keys, columns=bands.QUANTILES))


# MLlib jobs, and beside each what SQL can say of its output


def _inputs(spark, folder):
    """The panel and the day tables made of all orders are stored once; the jobs read them several times."""
    return durable(src.panel(spark, folder)), durable(src.oil(spark, folder)), durable(src.holidays(spark, folder))


_TRAINED: dict[tuple[str, str], dict] = {}


def _trained(spark, folder) -> dict:
    """One training run per session and folder; the queries below look at its parts."""
    from shelfcast.catalog.tables import scratch

    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        inputs = _inputs(spark, folder)
        _TRAINED[key] = training.train(*inputs, backtest_splits=5, save_to=scratch(spark, "models")) | {"inputs": inputs}
    return _TRAINED[key]


def _report(trained, model):
    return training.predict(model, trained["matrix"].where(F.col("slice") == "report"))


def _predictions(trained, model):
    return rounded(_report(trained, model).select("date", *SERIES, F.col("label").alias("actual"), "prediction"))


def _report_rows(trained, model):
    """Keys, actuals and whether the prediction is a usable number."""
    usable = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.col("prediction") >= 0)
    return rounded(_report(trained, model).select("date", *SERIES, F.col("label").alias("actual"), usable.alias("usable")))


SLICE_CUTS = """days AS (SELECT date, COUNT(*) AS c FROM panel GROUP BY 1),
run AS (SELECT date, SUM(c) OVER (ORDER BY date) AS upto, SUM(c) OVER () AS n FROM days),
cuts AS (SELECT MIN(date) FILTER (upto > floor(CAST(0.7 AS DOUBLE) * n)) AS a,
  MIN(date) FILTER (upto > floor(CAST(0.775 AS DOUBLE) * n)) AS b, MIN(date) FILTER (upto > floor(CAST(0.85 AS DOUBLE) * n)) AS c FROM run),
sliced AS (SELECT panel.*, CASE WHEN date <= a THEN 'train' WHEN date <= b THEN 'stop' WHEN date <= cuts.c THEN 'calibrate'
  ELSE 'report' END AS slice FROM panel, cuts)"""
REPORT_ROWS = with_([src.PANEL, SLICE_CUTS], f"SELECT {KEYS}, {r('sales', 'actual')}, true AS usable FROM sliced WHERE slice = 'report'")

FOLDS = """fold_days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS u FROM (SELECT DISTINCT date FROM panel)),
pos AS (SELECT DISTINCT CAST(trunc(trunc(u * 0.5) + k * ((u - 31) - trunc(u * 0.5)) / 4.0) AS BIGINT) AS c, u
        FROM (SELECT MAX(u) AS u FROM fold_days), (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
folds AS (SELECT row_number() OVER (ORDER BY c) AS fold, a.date AS cutoff, e.date AS test_end
          FROM pos JOIN fold_days a ON a.i = c JOIN fold_days e ON e.i = least(c + 30, pos.u - 1))"""


@query("F2_boosted_trees")
def f2(spark, folder):
    trained = _trained(spark, folder)
    return _predictions(trained, trained["models"]["boosted"])


@query("F2_report_rows", REPORT_ROWS)
def f2_rows(spark, folder):
    trained = _trained(spark, folder)
    return _report_rows(trained, trained["models"]["boosted"])


@query("F2_tweedie_glm")
def f2_glm(spark, folder):
    trained = _trained(spark, folder)
    return _predictions(trained, training.fit(training.tweedie_glm(), trained["matrix"].where(F.col("slice") == "train")))


@query("F3_random_forest")
def f3(spark, folder):
    trained = _trained(spark, folder)
    return _predictions(trained, trained["models"]["forest"])


@query("F3_report_rows", REPORT_ROWS)
def f3_rows(spark, folder):
    trained = _trained(spark, folder)
    return _report_rows(trained, trained["models"]["forest"])


_LEARNED: dict[tuple[str, str], tuple] = {}


def _learned(spark, folder):
    """Model of one pass over the training matrix, and its predictions of the report slice."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LEARNED:
        matrix = _trained(spark, folder)["matrix"]
        model = training.fit_learners(matrix)
        _LEARNED[key] = model, durable(training.apply_learners(model, matrix.where(F.col("slice") == "report")).drop("features"))
    return _LEARNED[key]


def _points(spark, folder, column):
    return rounded(_learned(spark, folder)[1].select("date", *SERIES, F.col("label").alias("actual"), F.col(column).alias("prediction")))


@query("F2_tweedie_trees")
def f2_tweedie(spark, folder):
    return _points(spark, folder, "by_level")


@query("F3_best_first_trees")
def f3_best_first(spark, folder):
    return _points(spark, folder, "by_leaf")


@query("F5_quantile_trees")
def f5_trees(spark, folder):
    found = _learned(spark, folder)[1]
    return rounded(found.select("date", *SERIES, F.col("label").alias("actual"), "p10", "p50", "p90"))


@query("F5_band_figures")
def f5_figures(spark, folder):
    """Coverage and pinball loss on the report slice: quantile trees against constant offsets of the holdout residuals."""
    trained, learned = _trained(spark, folder), _learned(spark, folder)[1]
    fixed = bands.residual_quantiles(trained["holdout"], trained["offsets"], SERIES)
    parts = []
    for name, df, columns in (("trees", learned, ("p10", "p50", "p90")), ("offsets", fixed, bands.QUANTILES)):
        for q, c in zip(training.BAND_QUANTILES, columns):
            gap = F.col("label") - F.col(c)
            parts.append(df.agg(
                F.lit(name).alias("band"), F.lit(q).alias("quantile"), F.avg((gap <= 0).cast("double")).alias("covered"),
                F.avg(F.greatest(gap * q, gap * (q - 1))).alias("pinball"),
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query("F10_search")
def f10(spark, folder):
    return rounded(training.tune(_trained(spark, folder)["matrix"]))


#: Time limit of the registered search; a limit is part of the search.
SEARCH_SECONDS = 90


@query("F10_learned_search")
def f10_learned(spark, folder):
    from shelfcast.plans.search import tune_boosters

    return rounded(tune_boosters(_trained(spark, folder)["matrix"], seconds=SEARCH_SECONDS))


@query("F11_cross_validation")
def f11(spark, folder):
    return rounded(training.cross_validate(_trained(spark, folder)["matrix"], training.random_forest))


@query(
    "F11_folds",
    with_(
        [
            src.PANEL,
            """fold_days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS u FROM (SELECT DISTINCT date FROM panel))""",
        ],
        """SELECT k AS fold, date AS cutoff FROM fold_days, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS k)
        WHERE i = u - (u // 6) * (6 - k) - 1""",
    ),
)
def f11_folds(spark, folder):
    """Fold numbers and cutoffs of a finished cross validation, here of the linear model."""
    scores = training.cross_validate(_trained(spark, folder)["matrix"], training.tweedie_glm)
    return rounded(scores.where("score >= 0").select("fold", "cutoff"))


@query("F12_backtest_of_model")
def f12_model(spark, folder):
    return rounded(_trained(spark, folder)["backtest"])


@query("F12_backtest_of_tweedie_trees")
def f12_trees(spark, folder):
    """All folds in one pass over the matrix a tree level."""
    return rounded(training.boosted_backtest(_trained(spark, folder)["matrix"]))


@query(
    "F12_folds_of_model",
    with_(
        [src.PANEL, FOLDS],
        """SELECT fold, cutoff, COUNT(*) FILTER (date <= cutoff) AS n_train,
        COUNT(*) FILTER (date > cutoff AND date <= test_end) AS n_test FROM folds, panel GROUP BY fold, cutoff""",
    ),
)
def f12_folds(spark, folder):
    return rounded(_trained(spark, folder)["backtest"].where("wmape >= 0 and mae >= 0").select("fold", "cutoff", "n_train", "n_test"))


@query("F13_importance")
def f13(spark, folder):
    trained = _trained(spark, folder)
    return training.top_features(training.importance(trained["models"]["forest"], trained["columns"], spark), 20)


@query(
    "F13_shares",
    "SELECT CAST(1.0 AS DOUBLE) AS shares, CAST(1.0 AS DOUBLE) AS last_cumulative, true AS each_in_range, CAST(0 AS BIGINT) AS repeated",
)
def f13_shares(spark, folder):
    trained = _trained(spark, folder)
    table = training.importance(trained["models"]["forest"], trained["columns"], spark)
    return rounded(
        table.agg(
            F.sum("share").alias("shares"),
            F.max("cumulative_share").alias("last_cumulative"),
            F.bool_and(F.col("share").between(0, 1)).alias("each_in_range"),
            (F.count("feature") - F.countDistinct("feature")).alias("repeated"),
        )
    )


@query("F14_saved_model")
def f14(spark, folder):
    trained = _trained(spark, folder)
    return _predictions(trained, training.load_model(trained["saved"]["forest"]))


@query(
    "F14_same_after_loading",
    with_([src.PANEL, SLICE_CUTS], "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS different FROM sliced WHERE slice = 'report'"),
)
def f14_same(spark, folder):
    trained = _trained(spark, folder)
    before = _report(trained, trained["models"]["forest"]).select("date", *SERIES, F.col("prediction").alias("before"))
    after = _report(trained, training.load_model(trained["saved"]["forest"])).select("date", *SERIES, F.col("prediction").alias("after"))
    both = before.join(after, ["date", *SERIES])
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("different"))


def _forecast(spark, folder):
    trained = _trained(spark, folder)
    history, oil, holidays = trained["inputs"]
    return forecast(history, src.future(spark, folder, history=history), trained, oil, holidays, check_grain=False)


@query("F15_forecast")
def f15(spark, folder):
    return rounded(_forecast(spark, folder))


@query("F15_forecast_rows", with_([src.PANEL, src.FUTURE], f"SELECT {KEYS}, true AS ordered, true AS banded FROM future"))
def f15_rows(spark, folder):
    low, middle, high = bands.QUANTILES
    ordered = (F.col("forecast") >= 0) & (F.col(low) >= 0) & (F.col(low) <= F.col(middle)) & (F.col(middle) <= F.col(high))
    return rounded(
        _forecast(spark, folder).select("date", *SERIES, ordered.alias("ordered"), (F.col(high) > F.col(low)).alias("banded"))
    )


@query("F15_forecast_from_trees")
def f15_trees(spark, folder):
    """Tweedie points of both kinds of trees, bands of the quantile trees."""
    trained = _trained(spark, folder) | {"learned": _learned(spark, folder)[0]}
    history, oil, holidays = trained["inputs"]
    return rounded(forecast(history, src.future(spark, folder, history=history), trained, oil, holidays, check_grain=False))


# The last days of the panel come to the state twice: as new days with wrong sales, then corrected.
STATE_DAYS = 20
STATE_LAGS = [k for k in features.LAGS if k >= src.HORIZON]
STATE_NAMES = [
    *[f"sales_lag_{k}" for k in STATE_LAGS], *[f"onpromotion_lag_{k}" for k in features.PROMO_LAGS],
    *[f"sales_rolling_{name}_{n}" for n in training.MODEL_WINDOWS for name in ("mean", "std", "min", "max")],
    *[f"promo_frequency_{n}d" for n in features.PROMO_WINDOWS], "days_since_promo", "promo_streak",
]


def _state(inputs):
    history, oil, holidays = inputs
    last = history.agg(F.max("date")).first()[0]
    old = history.where(F.col("date") <= F.date_sub(F.lit(last), STATE_DAYS))
    new = history.where(F.col("date") > F.date_sub(F.lit(last), STATE_DAYS))
    state = series_state(old, oil, holidays, src.HORIZON)
    state = advance(state, new.withColumn("sales", F.col("sales") + 1), oil, holidays, src.HORIZON)
    return advance(state, new, oil, holidays, src.HORIZON)


def _state_sql():
    over = lambda frame: f"OVER ({BY_DATE} ROWS BETWEEN {frame})"
    parts = [f"lag(sales, {k}) OVER ({BY_DATE}) AS sales_lag_{k}" for k in STATE_LAGS]
    parts += [f"lag(onpromotion, {k}) OVER ({BY_DATE}) AS onpromotion_lag_{k}" for k in features.PROMO_LAGS]
    for n in training.MODEL_WINDOWS:
        frame = over(f"{n - 1 + src.HORIZON} PRECEDING AND {src.HORIZON} PRECEDING")
        calls = (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))
        parts += [f"{fn}(sales) {frame} AS sales_rolling_{name}_{n}" for name, fn in calls]
    parts += [f"AVG(onpromotion) {over(f'{n - 1} PRECEDING AND CURRENT ROW')} AS promo_frequency_{n}d" for n in features.PROMO_WINDOWS]
    running = over("UNBOUNDED PRECEDING AND CURRENT ROW")
    runs = f"""rn - COALESCE(MAX(CASE WHEN onpromotion = 1 THEN rn END) {running}, 0) AS days_since_promo,
    rn - COALESCE(MAX(CASE WHEN onpromotion <> 1 THEN rn END) {running}, 0) AS promo_streak"""
    fills = [c for c in STATE_NAMES if c.startswith(("sales_", "onpromotion_"))]
    filled = ", ".join(f"COALESCE(last_value({c} IGNORE NULLS) {running}, 0) AS {c}" for c in fills)
    return with_(
        [
            src.PANEL, src.FUTURE,
            """stacked AS (SELECT date, store_nbr, family, sales, onpromotion, false AS ahead FROM panel
            UNION ALL SELECT date, store_nbr, family, NULL, onpromotion, true FROM future),
            counted AS (SELECT *, row_number() OVER (""" + BY_DATE + """) AS rn FROM stacked)""",
            f"built AS (SELECT date, store_nbr, family, ahead, {', '.join(parts)}, {runs} FROM counted)",
            f"filled AS (SELECT * REPLACE ({filled}) FROM built)",
        ],
        f"SELECT {KEYS}, {', '.join(b(c, c) if c in ('days_since_promo', 'promo_streak') or c.startswith('onpromotion_') else r(c, c) for c in STATE_NAMES)}"
        " FROM filled WHERE ahead",
    )


@query("F15_features_from_state", _state_sql())
def f15_features(spark, folder):
    """Features of the future rows from a state that was advanced twice, the SQL's from the whole history."""
    inputs = history, oil, holidays = _inputs(spark, folder)
    found = features_from_state(_state(inputs), src.future(spark, folder, history=history), oil, holidays, src.HORIZON)
    return rounded(found.select("date", *SERIES, *STATE_NAMES))


@query("F15_forecast_from_state")
def f15_state(spark, folder):
    """The forecasts of F15_forecast without reading the history."""
    trained = _trained(spark, folder)
    history, oil, holidays = trained["inputs"]
    ahead = src.future(spark, folder, history=history)
    return rounded(forecast_from_state(_state(trained["inputs"]), ahead, trained, oil, holidays, src.HORIZON))


@query("F16_training")
def f16(spark, folder):
    """Metrics of the report slice, figures of every backtest fold and features of every saved model."""
    trained = _trained(spark, folder)
    metrics = [(k, float(v)) for k, v in trained["metrics"].items()]
    folds = [(f"backtest_{f.fold}_{k}", float(f[k])) for f in trained["backtest"].collect() for k in ("n_train", "n_test", "wmape", "mae")]
    saved = [(f"features_of_{n}", float(len(training.model_info(p, spark).first().features))) for n, p in trained["saved"].items()]
    return spark.createDataFrame(sorted([*metrics, *folds, *saved]), "metric string, value double")


@query(
    "F16_slices",
    with_([src.PANEL, SLICE_CUTS], "SELECT slice, COUNT(*) AS rows, MIN(date) AS first_date, MAX(date) AS last_date FROM sliced GROUP BY 1"),
)
def f16_slices(spark, folder):
    matrix = _trained(spark, folder)["matrix"]
    return matrix.groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


# W15 and T4 on relevance instead of a fitted model, so that SQL can follow

RELEVANCE = f"""l AS (SELECT sales, onpromotion, lag(sales, 1) OVER ({BY_DATE}) AS lag_1, lag(sales, 7) OVER ({BY_DATE}) AS lag_7,
  lag(sales, 14) OVER ({BY_DATE}) AS lag_14 FROM panel),
imp AS (SELECT feature, importance FROM (SELECT ABS(corr(onpromotion, sales)) AS onpromotion, ABS(corr(lag_1, sales)) AS lag_1,
  ABS(corr(lag_7, sales)) AS lag_7, ABS(corr(lag_14, sales)) AS lag_14 FROM l)
  UNPIVOT (importance FOR feature IN (onpromotion, lag_1, lag_7, lag_14)))"""


def relevance(spark, folder):
    from pyspark.sql import Window

    from shelfcast.operators.features import feature_relevance

    w = Window.partitionBy(*SERIES).orderBy("date")
    df = src.panel(spark, folder).select(
        "sales", "onpromotion", *[F.lag("sales", k).over(w).alias(f"lag_{k}") for k in (1, 7, 14)]
    )
    table = feature_relevance(df, ["onpromotion", "lag_1", "lag_7", "lag_14"])
    return table.withColumnRenamed("relevance", "importance")


@query(
    "W15_cumulative_importance",
    with_(
        [src.PANEL, RELEVANCE],
        f"""SELECT feature, {r('importance', 'importance')}, {r('importance / SUM(importance) OVER ()', 'share')},
        {r('SUM(importance) OVER (ORDER BY importance DESC, feature) / SUM(importance) OVER ()', 'cumulative_share')} FROM imp""",
    ),
)
def w15(spark, folder):
    return rounded(training.cumulative_importance(relevance(spark, folder)))


@query("T4_top_features", with_([src.PANEL, RELEVANCE], f"SELECT feature, {r('importance', 'importance')} FROM imp ORDER BY 2 DESC, 1 LIMIT 3"))
def t4(spark, folder):
    return rounded(training.top_features(relevance(spark, folder), 3))
