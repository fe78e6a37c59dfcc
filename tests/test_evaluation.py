import json
import math

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import bands, evaluation


@pytest.fixture
def pairs(spark):
    def build(actual, predicted):
        rows = [(i, 1, "A", a, p) for i, (a, p) in enumerate(zip(actual, predicted))]
        return spark.createDataFrame(rows, "date int, store_nbr int, family string, actual double, predicted double")

    return build


def test_perfect(pairs):
    row = evaluation.accuracy(pairs([10.0, 20.0, 30.0], [10.0, 20.0, 30.0])).first()
    assert (row.mae, row.rmse, row.wmape, row.r2) == (0, 0, 0, 1)


def test_hand_worked(pairs):
    df = pairs([10.0, 20.0, 30.0, 40.0], [11.0, 19.0, 31.0, 39.0])
    row = evaluation.accuracy(df).first()
    assert (row.mae, row.mbe, row.wmape) == (1.0, 0.0, 4.0)
    assert row.mape == pytest.approx((10 + 5 + 10 / 3 + 2.5) / 4)
    assert row.r2 == pytest.approx(1 - 4 / 500)
    seq = evaluation.sequence_metrics(df).first()
    assert seq.mase == pytest.approx(0.1) and seq.directional_accuracy == 100
    assert evaluation.sequence_metrics(df, ["date"]).first().mase == pytest.approx(0.1)


def test_missing_pairs(pairs):
    row = evaluation.accuracy(pairs([10.0, math.nan, 30.0, None, 5.0], [11.0, 20.0, 31.0, 1.0, math.inf])).first()
    assert row.n == 2 and row.mae == 1.0


def test_undefined_figures(pairs):
    zero = evaluation.accuracy(pairs([0.0, 0.0], [0.0, 1.0])).first()
    assert zero.mape is None and zero.wmape is None and zero.r2 is None and zero.smape == pytest.approx(200)
    assert evaluation.sequence_metrics(pairs([5.0, 5.0], [1.0, 2.0])).first().mase is None
    assert evaluation.ljung_box(pairs([1.0] * 9, [float(i) for i in range(9)])).first().statistic is None


def test_report(pairs):
    actual = [float(10 + i % 5) for i in range(40)]
    df = pairs(actual, [a + (-1) ** i for i, a in enumerate(actual)])
    report = evaluation.evaluation_report(df, "m")
    row = report.first()
    assert row.model == "m" and row.n == 40
    assert row.recommendations[0] == "Excellent forecast accuracy - model is production ready"
    assert any(t.startswith("Autocorrelation") for t in row.recommendations)
    assert json.loads(evaluation.report_json(report).first().report)["mae"] == 1.0


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)], "model string, wmape double")
    assert [r.wmape_rank for r in evaluation.compare_models(df).orderBy("model").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_quantiles_never_cross(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, -1.0)], ["k", *bands.QUANTILES])
    row = bands.straighten(df).first()
    assert [row[c] for c in bands.QUANTILES] == [0.0, 2.0, 5.0]


def test_ensemble_weights():
    assert bands.ensemble_weights(["a", "b"], {"a": 3}) == {"a": 0.75, "b": 0.25}
    assert bands.ensemble_weights(["a", "b"], {"a": 0, "b": 0}) == {"a": 0.5, "b": 0.5}


def test_interval_honours_the_level(spark):
    df = spark.createDataFrame([(10.0,)], "prediction double")
    narrow, wide = (bands.normal_interval(df, c, 2.0).first() for c in (0.5, 0.95))
    assert narrow.upper < wide.upper == pytest.approx(10 + 1.959964 * 2)
    assert bands.heuristic_band(df).select(F.round("lower", 6), F.round("upper", 6)).first()[:] == (9.0, 11.0)


def test_p_value_column_follows_the_exact_value(spark):
    from pyspark.sql import functions as F

    from shelfcast.functions.stats import correlation_p_value, correlation_p_value_column

    cases = [(r, n) for r in (-0.99, -0.4, 0.0, 0.01, 0.3, 1.0) for n in (3, 4, 5, 12, 300, 100_000)] + [(0.5, 2), (None, 10)]
    rows = spark.createDataFrame(cases, "r double, n long")
    found = rows.select("r", "n", correlation_p_value_column(F.col("r"), F.col("n")).alias("p")).collect()
    for f in found:
        want = correlation_p_value(f.r, f.n)
        assert f.p == pytest.approx(want, rel=1e-5, abs=1e-9, nan_ok=True), f
