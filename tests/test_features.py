from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import external, features
from shelfcast.operators.reports import anomalies
from shelfcast.plans.features import engineer
from tests.conftest import DAY0


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_lag_is_the_previous_row(series):
    out = features.add_lags(series([float(i) for i in range(20)]))
    assert column(out, "sales_lag_1") == [None, *[float(i) for i in range(19)]]


def test_rolling_values(series):
    out = features.add_rolling(series([1.0, 2.0, 6.0, 4.0]), windows=(2,))
    assert column(out, "sales_rolling_mean_2") == [1.0, 1.5, 4.0, 5.0]
    assert column(out, "sales_rolling_std_2")[0] is None
    assert column(out, "sales_rolling_max_2") == [1.0, 2.0, 6.0, 6.0]
    past = features.add_rolling(series([1.0, 2.0, 6.0, 4.0]), windows=(2,), gap=1)
    assert column(past, "sales_rolling_mean_2") == [None, 1.0, 1.5, 4.0]


@pytest.mark.parametrize(
    "promo, since, streak",
    [
        ([0, 0, 1, 0, 2, 1, 1], [1, 2, 0, 1, 2, 0, 0], [0, 0, 1, 0, 0, 1, 2]),
        ([1, 1, 1], [0, 0, 0], [1, 2, 3]),
        ([0, 0], [1, 2], [0, 0]),
        ([1, 0, 3, 0], [0, 1, 2, 3], [1, 0, 0, 0]),
    ],
)
def test_promo_runs(series, promo, since, streak):
    out = features.add_promo_runs(series([1.0] * len(promo), promo))
    assert column(out, "days_since_promo") == since
    assert column(out, "promo_streak") == streak


def test_any_positive_promo(series):
    out = features.add_promo_runs(series([1.0] * 4, [1, 0, 3, 0]), any_positive=True)
    assert column(out, "days_since_promo") == [0, 1, 0, 1]


def test_calendar_edges(spark):
    days = [date(2016, 2, 29), date(2016, 12, 31), date(2017, 1, 1), date(2016, 10, 1), date(2024, 12, 30)]
    df = features.add_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    rows = {r.date: r for r in df.collect()}
    assert rows[days[0]].is_month_end and not rows[days[0]].is_quarter_end
    assert rows[days[1]].is_year_end and rows[days[1]].is_quarter_end and rows[days[1]].is_weekend
    assert rows[days[2]].is_year_start and rows[days[2]].is_quarter_start and rows[days[2]].day_of_week == 6
    assert rows[days[3]].is_quarter_start and not rows[days[3]].is_year_start
    assert rows[days[4]].week_of_year == 1


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame(
        [
            (date(2015, 1, 1), "Holiday", "National", False), (date(2015, 1, 15), "Holiday", "National", False),
            (date(2015, 1, 15), "Event", "Local", True),
        ],
        "date date, type string, locale string, transferred boolean",
    )


def test_holidays(make_panel, holidays):
    by_date = external.holidays_by_date(holidays)
    row = by_date.where("date = '2015-01-15'").first()
    assert (row.holiday_type, row.holiday_locale, row.is_transferred) == ("Event;Holiday", "Local;National", 1)
    joined = external.with_holidays(make_panel(20), by_date)
    assert joined.where("is_holiday is null or holiday_type is null").count() == 0
    assert joined.where("is_holiday = 1").select("date").distinct().count() == 2


def test_holiday_distances(make_panel, holidays):
    out = external.with_holiday_distances(make_panel(600, (1,), ("A",)), holidays)
    rows = {r.date: (r.days_to_holiday, r.days_from_holiday) for r in out.collect()}
    assert rows[date(2015, 1, 1)] == (14, 365)
    assert rows[date(2015, 1, 5)] == (10, 4)
    assert rows[date(2015, 1, 15)] == (365, 14)
    assert rows[date(2015, 1, 20)] == (365, 5)
    assert rows[date(2016, 6, 1)] == (365, 365)


def test_index_gaps(spark):
    values = [None, 50.0, None, 52.0, None]
    oil = spark.createDataFrame([(DAY0 + timedelta(days=i), v) for i, v in enumerate(values)], "date date, dcoilwtico double")
    out = external.index_features(oil)
    assert column(out, "dcoilwtico") == [50.0, 50.0, 50.0, 52.0, 52.0]
    assert column(out, "oil_price_lag_1") == [50.0, 50.0, 50.0, 50.0, 52.0]
    assert column(out, "oil_price_ma_7") == [None] * 5


def test_transactions_do_not_cross_stores(spark):
    rows = [(DAY0 + timedelta(days=i), s, float(10 * s + i)) for s in (1, 2) for i in range(3)]
    out = external.transaction_features(spark.createDataFrame(rows, "date date, store_nbr int, transactions double"))
    first = out.where((F.col("store_nbr") == 2) & (F.col("date") == DAY0)).first()
    assert first.transactions_lag_1 == 0.0 and first.transactions_growth == 0.0


def test_chain_has_no_infinity(spark, make_panel, holidays):
    panel = make_panel(40, promo=lambda i: i % 4)
    oil = spark.createDataFrame([(DAY0 + timedelta(days=i), 50.0) for i in range(30)], "date date, dcoilwtico double")
    tx = spark.createDataFrame(
        [(DAY0 + timedelta(days=i), s, float(i % 3)) for i in range(40) for s in (1, 2)],
        "date date, store_nbr int, transactions double",
    )
    out = engineer(panel, oil, holidays, tx)
    assert out.count() == panel.count()
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    row = out.agg(*[F.count_if(F.abs(c) == float("inf")).alias(c) for c in doubles]).first()
    assert not any(row)
    assert {"oil_month", "promo_holiday", "days_to_holiday", "transactions_ma_7", "promo_streak"} <= set(out.columns)


def test_model_features_ignore_the_present(make_panel):
    panel = make_panel(120, (1,), ("A",))
    changed = panel.withColumn("sales", F.when(F.col("date") >= "2015-04-25", 1e6).otherwise(F.col("sales")))
    from shelfcast.operators.profile import feature_columns
    from shelfcast.plans.training import model_features

    a, b = (model_features(p, horizon=14, windows=(7,)).where("date = '2015-04-30'") for p in (panel, changed))
    names = feature_columns(a)
    assert a.select(*names).first() == b.select(*names).first()


def test_one_shuffle_for_all_series_features(spark, make_panel):
    from shelfcast.plans.durable import durable

    plan = engineer(durable(make_panel(30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ungrouped_equals_plain_window(spark):
    daily = spark.createDataFrame([(DAY0 + timedelta(days=i), float(i * i % 17)) for i in range(300)], "date date, sales double")
    out = features.add_lags_ungrouped(daily, ["date"], lags=(1, 7), windows=(7,))
    from pyspark.sql import Window

    w = Window.orderBy("date")
    want = daily.select(
        "date", F.lag("sales", 1).over(w).alias("a"), F.lag("sales", 7).over(w).alias("b"),
        F.avg("sales").over(w.rowsBetween(-6, 0)).alias("c"),
    )
    got = out.select("date", "sales_lag_1", "sales_lag_7", "sales_rolling_mean_7")
    assert [tuple(r) for r in got.orderBy("date").collect()] == [tuple(r) for r in want.orderBy("date").collect()]


def test_lookback_across_chunks(spark):
    from shelfcast.operators.ordering import with_lookback

    df = spark.range(95).select("id", F.lit(1).alias("k"))
    out = with_lookback(df, [F.col("id")], 3, lambda w: [F.lag("id", 3).over(w).alias("p")], chunk=10)
    assert [r.p for r in out.orderBy("id").collect()] == [None] * 3 + list(range(92))


def test_running_totals_with_ties(spark):
    from shelfcast.operators.ordering import running_totals

    df = spark.range(500).select("id", F.lit(2.0).alias("v"))
    out = running_totals(df, [F.col("v").desc(), F.col("id")], {"s": "v"}).orderBy("id").collect()
    assert [r._pos for r in out] == list(range(1, 501))
    assert [r.s for r in out] == [2.0 * i for i in range(1, 501)]
    assert {r.s_total for r in out} == {1000.0}


def test_anomaly(spark):
    values = [10.0 + i % 2 for i in range(40)]
    values[20] = 500.0
    daily = spark.createDataFrame([(DAY0 + timedelta(days=i), v) for i, v in enumerate(values)], "date date, sales double")
    assert [r.date for r in anomalies(daily).where("is_anomaly").collect()] == [DAY0 + timedelta(days=20)]
    assert anomalies(daily.limit(4)).where("is_anomaly").count() == 0


def test_tables_without_series_raise(make_panel):
    from shelfcast.operators.features import add_lags, add_rolling

    bare = make_panel(5).drop("family")
    for build in (add_lags, add_rolling):
        with pytest.raises(ValueError, match="add_lags_ungrouped"):
            build(bare)


def test_series_features_use_no_single_task(make_panel):
    from shelfcast.plans.features import engineer

    plan = engineer(make_panel(40))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("gap", [0, 1, 5])
def test_wide_windows_equal_frames(spark, series, gap):
    values = [None if i % 7 == 3 or 40 < i < 75 else float(1e6 + (i * i) % 23) for i in range(130)]
    df = series(values).union(series(values[:3]).withColumn("family", F.lit("B")))
    widths = (1, 2, 7, 32, 33, 100)
    names = [f"sales_rolling_{s}_{n}" for n in widths for s in ("mean", "std", "min", "max")]
    keys = ["family", "date"]
    frames = features.add_rolling(df, windows=widths, gap=gap, fill=False).orderBy(*keys).select(*names).collect()
    wide = features.add_rolling_wide(df, windows=widths, gap=gap)
    assert wide.columns[: len(df.columns)] == df.columns
    for one, other in zip(frames, wide.orderBy(*keys).select(*names).collect()):
        for a, b in zip(one, other):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=1e-6)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
