import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import bands
from shelfcast.operators.profile import feature_columns
from shelfcast.plans.forecasting import forecast, forecast_from_state, history_with_future
from shelfcast.plans.state import advance, features_from_state, reach, series_state
from shelfcast.plans.training import fit, model_features, predict, random_forest, residuals, training_matrix
from tests.conftest import DAY0, PANEL_SCHEMA

HORIZON, LATE = 5, 4
OPTIONS = {"horizon": HORIZON, "windows": (3, 8)}


def rows(seed, days, series=((1, "A"), (1, "B"), (2, "A"))):
    """Series of unlike lengths with missing days, missing targets and runs of promotions."""
    rnd, out = random.Random(seed), []
    for k, (store, family) in enumerate(series):
        for i in range(k * 40, days):
            if rnd.random() < 0.9:
                sale = None if rnd.random() < 0.4 or 60 < i < 90 else float(rnd.randint(0, 90))
                out.append((DAY0 + timedelta(days=i), store, family, sale, rnd.choice([0, 0, 1, 1, 2])))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    oil = spark.createDataFrame(
        [(DAY0 + timedelta(days=i), None if i % 9 == 0 else 40.0 + i % 13) for i in range(0, 470)], "date date, dcoilwtico double"
    )
    holidays = spark.createDataFrame(
        [(DAY0 + timedelta(days=i), "Holiday", "National", "X", f"d{i}", False) for i in range(20, 470, 45)],
        "date date, type string, locale string, locale_name string, description string, transferred boolean",
    )
    return oil, holidays


def future_of(spark, first, series=((1, "A"), (2, "A"), (3, "NEW"))):
    return spark.createDataFrame(
        [(DAY0 + timedelta(days=first + h), s, f, int(h == 2)) for s, f in series for h in range(HORIZON)],
        "date date, store_nbr int, family string, onpromotion int",
    )


def found(df, columns):
    return sorted(tuple(r) for r in df.select("date", "store_nbr", "family", *columns).collect())


def whole(spark, history, future, tables):
    panel = spark.createDataFrame(history, PANEL_SCHEMA)
    wide = model_features(history_with_future(panel, future), *tables, **OPTIONS)
    return wide.where("is_future").drop("is_future")


@pytest.mark.parametrize("days", [3, 50, 130, 440])
def test_equal_to_the_whole_history(spark, tables, days):
    history, future = rows(days, days), future_of(spark, days)
    want = whole(spark, history, future, tables)
    state = series_state(spark.createDataFrame(history, PANEL_SCHEMA), *tables, late=LATE, **OPTIONS)
    got = features_from_state(state, future, *tables, **OPTIONS)
    columns = [c for c in want.columns if c not in ("date", "store_nbr", "family", "sales")]
    assert set(columns) <= set(got.columns) and len(columns) > 30
    assert found(got, columns) == found(want, columns)


def test_new_late_and_corrected_days(spark, tables):
    """Days come in turns, some late, some twice; the state is that of the corrected history."""
    history = rows(7, 440)
    by_turn = [[r for r in history if r[0] < DAY0 + timedelta(days=420)]]
    late = [r for r in by_turn[0][-30:] if r[0] >= DAY0 + timedelta(days=419)][:1]
    first = [r for r in by_turn[0] if r not in late]
    state = series_state(spark.createDataFrame(first, PANEL_SCHEMA), *tables, late=LATE, **OPTIONS)
    for low in range(420, 440, 4):
        turn = [r for r in history if DAY0 + timedelta(days=low) <= r[0] < DAY0 + timedelta(days=low + 4)]
        if low == 420:
            turn += late
        wrong = [(*r[:3], 77.0, 1 - min(r[4], 1)) for r in turn]
        state = advance(state, spark.createDataFrame(wrong, PANEL_SCHEMA), *tables, late=LATE, **OPTIONS)
        state = advance(state, spark.createDataFrame(turn, PANEL_SCHEMA), *tables, late=LATE, **OPTIONS)
    future = future_of(spark, 440)
    want = whole(spark, history, future, tables)
    columns = [c for c in want.columns if c not in ("date", "store_nbr", "family", "sales")]
    assert found(features_from_state(state, future, *tables, **OPTIONS), columns) == found(want, columns)
    fresh = series_state(spark.createDataFrame(history, PANEL_SCHEMA), *tables, late=LATE, **OPTIONS)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(state.select(*fresh.columns)) == key(fresh)


def test_size_does_not_grow_with_history(spark, make_panel):
    lengths = [
        series_state(make_panel(days), late=LATE, **OPTIONS).agg(F.max(F.size("tail"))).first()[0] for days in (500, 900)
    ]
    assert lengths == [reach(**OPTIONS) + LATE] * 2


def test_days_before_the_anchor_raise(spark, make_panel):
    panel = make_panel(40)
    state = series_state(panel, late=LATE, **OPTIONS)
    with pytest.raises(ValueError, match="rebuild"):
        advance(state, panel.where(F.col("date") == F.lit(DAY0 + timedelta(days=35))), late=LATE, **OPTIONS)
    with pytest.raises(ValueError, match="reaches"):
        advance(state, panel, horizon=400, windows=(3, 8))


def test_forecasts_equal_those_from_the_history(spark, make_panel):
    panel = make_panel(80, promo=lambda i: int(i % 5 == 0))
    wide = model_features(panel, horizon=HORIZON)
    columns = feature_columns(wide)
    matrix = training_matrix(wide, columns)
    models = {"forest": fit(random_forest(numTrees=3, maxDepth=3), matrix)}
    offsets = bands.pooled_offsets(residuals(predict(models["forest"], matrix)), ["store_nbr", "family"])
    trained = {"models": models, "columns": columns, "offsets": offsets}
    future = future_of(spark, 80, ((1, "GROCERY"), (2, "DAIRY")))
    want = forecast(panel, future, trained, horizon=HORIZON)
    got = forecast_from_state(series_state(panel, horizon=HORIZON, late=LATE), future, trained, horizon=HORIZON)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 2 * HORIZON


def test_state_and_future_come_from_the_stored_panel(spark, make_panel, monkeypatch):
    """The queries on the kept state read the tables once, for the stored inputs."""
    from shelfcast.catalog import forecasting, inputs

    panel, read = make_panel(60), []
    oil = spark.createDataFrame([(DAY0, 1.0)], "date date, dcoilwtico double")
    holidays = spark.createDataFrame([(DAY0, "a", "b", False)], "date date, type string, locale string, transferred boolean")
    for name, df in (("panel", panel), ("oil", oil), ("holidays", holidays)):
        monkeypatch.setattr(inputs, name, lambda *_, name=name, df=df: read.append(name) or df)
    stored = forecasting._inputs(spark, "/nowhere")
    assert all("parquet" in f for df in stored for f in df.inputFiles()) and all(df.inputFiles() for df in stored)
    ahead = inputs.future(spark, "/nowhere", 3, stored[0])
    assert sorted({r["date"] for r in ahead.collect()}) == [DAY0 + timedelta(days=d) for d in (60, 61, 62)]
    assert ahead.count() == 12 and forecasting._state(stored).count() == 4
    forecasting.f15_features(spark, "/nowhere").count()
    assert read == ["panel", "oil", "holidays"] * 2
