from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.profile import feature_columns
from shelfcast.plans import training
from shelfcast.plans.folds import chronological_split, expanding_folds, rolling_folds
from shelfcast.plans.forecasting import forecast, history_with_future
from tests.conftest import DAY0

FOREST = {"numTrees": 8, "maxDepth": 5}


@pytest.fixture(scope="module")
def panel(make_panel):
    from shelfcast.plans.durable import durable

    return durable(make_panel(200, (1, 2), ("GROCERY",), promo=lambda i: int(i % 9 == 0)))


@pytest.fixture(scope="module")
def trained(panel):
    return training.train(panel, horizon=14, trees={"maxIter": 5, "maxDepth": 4}, forest=FOREST)


def test_split(panel):
    train, held = chronological_split(panel)
    assert train.count() + held.count() == panel.count()
    assert train.agg(F.max("date")).first()[0] == DAY0 + timedelta(days=160)
    assert held.agg(F.min("date")).first()[0] == DAY0 + timedelta(days=161)


def test_folds(panel):
    folds = rolling_folds(panel, n_splits=3, horizon=20)
    assert [f.cutoff for f in folds] == [DAY0 + timedelta(days=d) for d in (100, 139, 179)]
    assert folds[-1].test_end == DAY0 + timedelta(days=199)
    assert rolling_folds(panel, n_splits=5, horizon=300) == []
    blocks = expanding_folds(panel, 3)
    assert blocks[-1].test_end == DAY0 + timedelta(days=199) and blocks[0].test_end == blocks[1].cutoff


def test_training_beats_the_mean(trained, panel):
    matrix = trained["matrix"]
    report = matrix.where("slice = 'report'")
    mean = matrix.where("slice = 'train'").agg(F.avg("label")).scalar()
    naive = training.score(report.withColumn("prediction", mean))["wmape"]
    assert trained["metrics"]["wmape"] < naive < 100
    assert trained["holdout"].where("prediction < 0").count() == 0


def test_importance(trained, spark):
    table = training.importance(trained["models"]["forest"], trained["columns"], spark)
    assert table.count() == len(trained["columns"])
    assert table.agg(F.max("cumulative_share")).first()[0] == pytest.approx(1)
    assert training.top_features(table, 5).count() == 5


def test_saved_model_gives_the_same(trained, spark, tmp_path):
    rows = trained["matrix"].where("slice = 'report'")
    path = training.save_model(trained["models"]["forest"], str(tmp_path / "m"), spark, "forest", trained["columns"], {"wmape": 1.0})
    again = training.predict(training.load_model(path), rows)
    before = training.predict(trained["models"]["forest"], rows)
    keys = ["date", "store_nbr", "family"]
    assert [r.prediction for r in again.orderBy(*keys).collect()] == [r.prediction for r in before.orderBy(*keys).collect()]
    info = training.model_info(path, spark).first()
    assert info.name == "forest" and info.features == trained["columns"]


def _future(panel, days=14):
    keys = panel.select("store_nbr", "family").distinct()
    ahead = keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return ahead.select(
        F.date_add(F.lit(DAY0 + timedelta(days=200)), F.col("i")).alias("date"), "store_nbr", "family",
        F.lit(0).alias("onpromotion"),
    )


def test_forecast(trained, panel):
    out = forecast(panel, _future(panel), trained, horizon=14)
    rows = out.collect()
    assert len(rows) == 28
    for r in rows:
        assert r.forecast >= 0 and r.forecast_lo <= r.forecast_md <= r.forecast_hi


def test_future_target(panel):
    stacked = history_with_future(panel, _future(panel), 30)
    assert stacked.where("is_future and sales is not null").count() == 0
    assert stacked.where("not is_future").count() == 60
    parity = history_with_future(panel, _future(panel), 30, future_target=0.0)
    assert parity.where("is_future").agg(F.max("sales")).first()[0] == 0.0


def test_search_and_validation(trained):
    matrix = trained["matrix"]
    trials = training.tune(matrix, training.random_forest, trials=2, folds=2, ranges={"numTrees": (2, 4), "maxDepth": (2, 3)})
    assert trials.count() == 2 and trials.where("is_best").count() == 1
    scores = training.cross_validate(matrix, lambda: training.random_forest(**FOREST), folds=2)
    assert scores.where("score < 100").count() == 2
    assert training.sample_settings(3) == training.sample_settings(3)


def test_backtests(trained, panel):
    fitted = training.rolling_backtest(trained["matrix"], lambda: training.random_forest(**FOREST), n_splits=2, horizon=14)
    assert [r.fold for r in fitted.collect()] == [1, 2]
    mean = training.mean_backtest(panel, n_splits=2, horizon=14)
    assert mean.count() == 2 and mean.where("n_test = 28").count() == 2


def test_glm(trained):
    rows = trained["matrix"].where("slice = 'train'")
    model = training.fit(training.tweedie_glm(), rows)
    assert training.score(training.predict(model, rows))["wmape"] < 30


def test_empty_input(trained):
    with pytest.raises(ValueError):
        training.fit(training.random_forest(), trained["matrix"].limit(0))


def test_feature_columns_leave_out_keys(trained):
    assert not {"sales", "date", "store_nbr", "family"} & set(trained["columns"])
    assert feature_columns(trained["matrix"]) == ["label"]


def test_features_of_a_row_are_the_same_in_both_jobs(make_panel):
    """A panel with gaps: what the forecast job builds for later rows is what training builds for them."""
    from shelfcast.plans.durable import durable
    from shelfcast.plans.forecasting import future_features

    whole = make_panel(520, (1, 2), ("GROCERY", "DAIRY"), promo=lambda i: int(i % 11 == 0))
    gappy = durable(whole.where("(dayofyear(date) * 7 + store_nbr * 3) % 5 <> 0"))
    last = DAY0 + timedelta(days=489)
    built = training.model_features(gappy, horizon=30)
    columns = feature_columns(built)
    keys = ["date", "store_nbr", "family"]
    want = built.where(F.col("date") > F.lit(last)).select(*keys, *columns)
    future = gappy.where(F.col("date") > F.lit(last)).drop("sales")
    got = future_features(gappy.where(F.col("date") <= F.lit(last)), future, columns, horizon=30).select(*keys, *columns)
    rows = [sorted(map(tuple, df.collect()), key=str) for df in (want, got)]
    assert len(rows[0]) > 50
    for a, b in zip(*rows):
        assert a == pytest.approx(b, nan_ok=True)


def test_no_feature_holds_the_rows_own_target(make_panel):
    panel = make_panel(60, (1,), ("GROCERY",))
    changed = panel.withColumn("sales", F.when(F.col("date") == F.lit(DAY0), 1e6).otherwise(F.col("sales")))
    columns = feature_columns(training.model_features(panel, horizon=14))
    first = [training.model_features(p, horizon=14).where(F.col("date") == F.lit(DAY0)).select(*columns).first() for p in (panel, changed)]
    assert first[0] == first[1]


def test_line_rows_raise(make_panel):
    panel = make_panel(40, (1,), ("GROCERY",))
    with pytest.raises(ValueError, match="to_daily_grain"):
        training.train(panel.union(panel))


def test_job_with_backtest_and_saved_models(panel, spark, tmp_path):
    small = {"numTrees": 3, "maxDepth": 3}
    done = training.train(panel, horizon=14, trees={"maxIter": 3}, forest=small, backtest_splits=2, save_to=str(tmp_path / "run"))
    assert done["backtest"].count() == 2
    for name, path in done["saved"].items():
        assert training.model_info(path, spark).first().name == name
    slices = {r["slice"] for r in done["matrix"].select("slice").distinct().collect()}
    assert slices == set(training.SLICES)


def test_search_settings_cover_what_the_trees_have():
    for settings in training.sample_settings(20):
        assert settings.keys() == training.SEARCH_RANGES.keys()
        training.early_stopped(**settings)


def test_bands_of_unknown_series_are_wide(spark):
    from shelfcast.operators import bands

    rows = [(s, f, float((i * 7 + s) % 11 - 5)) for s in (1, 2) for f in ("A", "B") for i in range(40)]
    residuals = spark.createDataFrame(rows, "store_nbr int, family string, residual double")
    points = spark.createDataFrame(
        [(1, "A", 50.0), (1, "NEW", 50.0), (9, "A", 50.0)], "store_nbr int, family string, prediction double"
    )
    keys = ["store_nbr", "family"]
    out = {(r.store_nbr, r.family): r for r in bands.residual_quantiles(points, bands.pooled_offsets(residuals, keys), keys).collect()}
    assert [out[k].level for k in ((1, "A"), (1, "NEW"), (9, "A"))] == ["series", "group", "all"]
    assert all(r.forecast_hi > r.forecast_lo for r in out.values())
    few = bands.residual_quantiles(points, bands.pooled_offsets(residuals, keys, least=41), keys)
    assert {r.level for r in few.collect()} == {"group", "all"}
    plain = bands.residual_quantiles(points, bands.residual_offsets(residuals, keys), keys).where("family = 'NEW'").first()
    assert plain.forecast_lo is None and plain.level is None


def test_registered_history_is_whole(spark):
    import __spark_entry__ as entry
    from shelfcast.catalog import inputs

    folder = "/root/testdata/sf0.001"
    found = entry.queries()["U1_whole_history_and_future"](spark, folder)
    assert found.where("not is_future").count() == inputs.panel(spark, folder).count()


def test_registered_search_runs_all_trials(monkeypatch):
    from shelfcast.catalog import forecasting

    seen = []
    monkeypatch.setattr(forecasting, "_trained", lambda spark, folder: {"matrix": "m"})
    monkeypatch.setattr(forecasting, "rounded", lambda df: df)
    monkeypatch.setattr(training, "sample_settings", lambda trials, *a: seen.append(trials) or [])
    monkeypatch.setattr(training, "expanding_folds", lambda *a: [])
    monkeypatch.setattr(training, "in_parallel", lambda *a: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        forecasting.f10(None, None)
    assert seen == [training.TRIALS] == [50]


def test_job_backtests_the_boosted_trees(panel, monkeypatch):
    kinds = []
    monkeypatch.setattr(training, "rolling_backtest", lambda m, factory, *a, **b: kinds.append(type(factory()).__name__))
    for more in ({}, {"backtest_model": "forest"}):
        training.train(panel, horizon=14, trees={"maxIter": 2, "maxDepth": 2}, forest=FOREST, backtest_splits=2, **more)
    assert kinds == ["GBTRegressor", "RandomForestRegressor"]
    with pytest.raises(ValueError):
        training.train(panel, backtest_model="mean")


def test_histogram_learners(trained):
    """Both kinds of Tweedie trees beat the mean, and their bands are ordered."""
    matrix = trained["matrix"]
    model = training.fit_learners(matrix, training.learners(rounds=6, depth=3, step=0.5))
    report = matrix.where("slice = 'report'")
    found = training.apply_learners(model, report).persist()
    mean = matrix.where("slice = 'train'").agg(F.avg("label")).scalar()
    naive = training.score(report.withColumn("prediction", mean))["wmape"]
    for point in ("by_level", "by_leaf", "prediction"):
        assert training.score(found.withColumn("prediction", F.col(point)))["wmape"] < naive
    assert found.where("p10 < 0 or p10 > p50 or p50 > p90").count() == 0
    assert found.columns[: len(report.columns)] == report.columns


def test_backtest_of_all_folds_in_one_pass(trained, monkeypatch):
    from shelfcast.plans import boosting

    levels = []
    grow = boosting._Fit._level
    monkeypatch.setattr(boosting._Fit, "_level", lambda self, *a: levels.append(1) or grow(self, *a))
    table = training.boosted_backtest(trained["matrix"], n_splits=3, horizon=20, rounds=3, depth=2, step=0.5).collect()
    assert sorted(r["fold"] for r in table) == [1, 2, 3] and all(0 < r["wmape"] < 100 and r["n_test"] == 40 for r in table)
    assert len(levels) <= 6
    assert training.boosted_backtest(trained["matrix"], n_splits=3, horizon=500).count() == 0


def test_cut_history(panel):
    cut = history_with_future(panel, panel.limit(0), rows=60)
    assert [r["count"] for r in cut.groupBy("store_nbr").count().collect()] == [60, 60]


@pytest.fixture(scope="module")
def learned(panel, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("learners"))
    settings = {"rounds": 4, "depth": 3, "step": 0.5}
    return training.train(panel, horizon=14, trees=settings, learner="histogram", backtest_splits=2, save_to=folder, weights={"by_level": 3})


def test_histogram_learners_in_the_job(learned, panel, spark):
    report = learned["matrix"].where("slice = 'report'")
    mean = learned["matrix"].where("slice = 'train'").agg(F.avg("label")).scalar()
    assert learned["metrics"]["wmape"] < training.score(report.withColumn("prediction", mean))["wmape"]
    assert [r.fold for r in learned["backtest"].orderBy("fold").collect()] == [1, 2]
    again = training.load_learners(learned["saved"]["learners"], spark)
    assert again == learned["learned"]
    one = {(r.date, r.store_nbr): r for r in training.apply_learners(again, report, {"by_level": 3}).collect()}
    both = training.ensemble_predict(learned["models"], report, {"by_level": 3})
    for r in both.collect():
        row = one[r.date, r.store_nbr]
        assert r.prediction == pytest.approx(row.prediction) == pytest.approx(0.75 * row.by_level + 0.25 * row.by_leaf)


def test_forecast_from_histogram_learners(learned, panel):
    rows = forecast(panel, _future(panel), learned, horizon=14).collect()
    assert len(rows) == 28 and {r.level for r in rows} == {"trees"}
    assert all(0 <= r.forecast_lo <= r.forecast_md <= r.forecast_hi for r in rows)
    assert any(r.forecast_lo < r.forecast_hi for r in rows)


def test_unknown_learner(panel):
    with pytest.raises(ValueError, match="unknown learner"):
        training.train(panel, learner="other")


def test_search_finds_each_stop_date_once(trained, monkeypatch):
    """Trials of a fold share its stop date and its decoded rows, and score as fits alone do."""
    matrix, seen = trained["matrix"], []
    original = training.split_dates
    monkeypatch.setattr(training, "split_dates", lambda *a: seen.append(original(*a)) or seen[-1])
    ranges = {"maxIter": (2, 4), "maxDepth": (2, 3), "stepSize": (0.1, 0.3)}
    found = training.tune(matrix, trials=3, folds=2, ranges=ranges).orderBy("trial").collect()
    assert len(seen) == 2 and matrix.storageLevel.useMemory is False
    folds = expanding_folds(matrix, 2)
    for row, settings in zip(found, training.sample_settings(3, ranges=ranges)):
        alone = [
            training.score(training.predict(training.fit_fold(training.early_stopped(**settings), f.train(matrix, "date")), f.test(matrix, "date")))["wmape"]
            for f in folds
        ]
        assert row["wmape"] == pytest.approx(sum(alone) / 2, rel=1e-12)


def test_backtest_takes_its_stop_date_as_a_value(trained, monkeypatch):
    """A subquery would run again in every job of a fit."""
    plans = []
    original = training.fit
    monkeypatch.setattr(training, "fit", lambda e, rows: plans.append(rows._jdf.queryExecution().toString()) or original(e, rows))
    training.rolling_backtest(trained["matrix"], lambda: training.early_stopped(maxIter=2, maxDepth=2), 2, 14).collect()
    assert len(plans) == 2 and not any("scalar-subquery" in p.lower() for p in plans)
