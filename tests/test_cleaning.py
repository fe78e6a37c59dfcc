from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import cleaning, profile
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.plans.cleaning import clean, clean_with_report


def test_null_target_is_dropped(series):
    out = cleaning.fill_missing(series([None, 2.0, 3.0], [None, None, 1]))
    assert [(r.sales, r.onpromotion) for r in out.orderBy("date").collect()] == [(2.0, 0), (3.0, 1)]


def test_duplicates_are_halved(make_panel):
    panel = make_panel(5)
    both = panel.unionByName(panel)
    assert cleaning.drop_duplicates(both).count() == panel.count()
    counts = cleaning.duplicate_counts(both).first()
    assert counts.removed_count == counts.final_count == panel.count()


def test_duplicates_by_key(series):
    df = series([1.0, 2.0]).withColumn("date", F.lit(date(2015, 1, 1)))
    assert cleaning.drop_duplicates(df).count() == 2
    assert cleaning.drop_duplicates(df, ["date", "store_nbr", "family"]).count() == 1


def test_outlier_is_capped(make_panel):
    panel = make_panel(30).withColumn(
        "sales",
        F.when((F.col("date") == "2015-01-01") & (F.col("store_nbr") == 1) & (F.col("family") == "DAIRY"), 999999.0)
        .otherwise(F.col("sales")),
    )
    out = clean(panel)
    assert out.count() == panel.count()
    assert out.agg(F.max("sales")).first()[0] < 999999


def test_outlier_modes(series):
    df = series([10.0, 11.0, 12.0, 11.0, 10.0, 12.0, 11.0, -500.0])
    low = cleaning.replace_outliers(df).agg(F.min("sales")).first()[0]
    assert low == 10.0  # the low value moved up to the 99th percentile
    clipped = cleaning.replace_outliers(df, mode="clip").agg(F.min("sales")).first()[0]
    assert -500 < clipped < 10
    assert cleaning.replace_outliers(df, "zscore").count() == 8


def test_unknown_method_is_an_error(series):
    with pytest.raises(ValueError):
        cleaning.flag_outliers(series([1.0]), "isolation_forest")
    with pytest.raises(ValueError):
        cleaning.replace_outliers(series([1.0]), mode="drop")


def test_constant_series_has_no_outliers(series):
    for method in cleaning.OUTLIER_METHODS:
        flagged = cleaning.flag_outliers(series([5.0] * 6), method)
        assert flagged.where("is_outlier").count() == 0


def test_types(spark):
    raw = spark.createDataFrame(
        [("2015-01-01", 1, "A", "3.5", "1"), ("bad", 1, "A", "x", None), ("2015-01-03", 1, "A", "nan", "2")],
        "date string, store_nbr int, family string, sales string, onpromotion string",
    )
    rows = cleaning.coerce_types(raw).collect()
    assert [r.date for r in rows] == [date(2015, 1, 1), None, date(2015, 1, 3)]
    assert [r.sales for r in rows] == [3.5, None, None]


def test_fill_features_stays_in_the_series(spark):
    rows = [
        (date(2015, 1, 1), 1, "A", None), (date(2015, 1, 2), 1, "A", 4.0), (date(2015, 1, 3), 1, "A", None),
        (date(2015, 1, 1), 2, "A", None), (date(2015, 1, 2), 2, "A", None),
    ]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, x double")
    out = cleaning.fill_features(df, ["x"]).orderBy("store_nbr", "date")
    assert [r.x for r in out.collect()] == [4.0, 4.0, 4.0, 0.0, 0.0]


def test_quantiles_of_a_hot_key(spark):
    """One key holds most rows, many of them tied."""
    hot = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") % 700).cast("double").alias("v"))
    cold = spark.range(9).select(F.lit("cold").alias("k"), F.col("id").cast("double").alias("v"))
    got = exact_quantiles(hot.unionByName(cold), "v", {"q": 0.25, "m": 0.5, "p": 0.99}, ["k"])
    want = hot.unionByName(cold).groupBy("k").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.99)])))
    want = {r[0]: r[1] for r in want.collect()}
    for r in got.collect():
        assert [r.q, r.m, r.p] == pytest.approx(want[r.k])


def test_consistency_and_report(make_panel):
    panel = make_panel(10).where("date <> '2015-01-04'")
    row = profile.consistency_checks(panel).first()
    assert (row.missing_dates_count, row.store_count, row.family_count, row.duplicate_count) == (1, 2, 2, 0)
    assert profile.calendar_gaps(panel).first()[0] == date(2015, 1, 4)
    assert profile.gap_summary(panel).first().missing_dates_percentage == pytest.approx(10)
    cleaned, report = clean_with_report(panel)
    assert cleaned.count() == panel.count()
    assert {k: v.count() for k, v in report.items()} == dict.fromkeys(report, 1)


def test_skew_and_kurtosis_need_enough_rows(series):
    row = profile.target_profile(series([1.0, 2.0])).first()
    assert row.skewness is None and row.kurtosis is None and row.median == 1.5


def test_empty_model_input(series):
    with pytest.raises(ValueError):
        profile.require_rows(series([1.0]).limit(0))


def test_kept_row_follows_the_order(spark):
    from shelfcast.operators.cleaning import drop_duplicates

    rows = spark.createDataFrame([(1, 5.0, "b"), (1, 3.0, "c"), (1, 3.0, "a"), (2, None, "z"), (2, 1.0, "y")], "k int, v double, w string")
    kept = drop_duplicates(rows.repartition(3), ["k"], order=["v"]).orderBy("k").collect()
    assert [tuple(r) for r in kept] == [(1, 3.0, "a"), (2, None, "z")]
    assert drop_duplicates(rows.select("k"), ["k"]).count() == 2


def test_profile_and_mix_read_their_input_once(spark, make_panel, tmp_path):
    from shelfcast.operators.profile import target_profile
    from shelfcast.operators.reports import priority_mix

    path = str(tmp_path / "rows")
    make_panel(40).write.parquet(path)
    rows = spark.read.parquet(path)
    plan = target_profile(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "family" not in plan and target_profile(rows).first()["median"] is not None
    mixed = rows.select((rows.sales > 70).cast("string").alias("priority"))
    plan = priority_mix(mixed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
