import json

import numpy as np
import pytest

from shelfcast.plans import search, training

SURFACE = {"step": (0.01, 0.3), "depth": (3, 10), "l2": (0.0, 2.0), "rows": (0.6, 1.0)}


def hill(s):
    return (np.log(s["step"] / 0.06)) ** 2 + 0.1 * (s["depth"] - 7) ** 2 + (s["l2"] - 0.4) ** 2 + 8 * (s["rows"] - 0.85) ** 2


def test_learning_beats_random_draws(monkeypatch):
    """Equal trials on a known surface over 20 seeds."""
    learnt = [min(v for _, v in search.minimise(hill, SURFACE, 50, seed)) for seed in range(20)]
    monkeypatch.setattr(search, "RANDOM_TRIALS", 1_000)
    drawn = [min(v for _, v in search.minimise(hill, SURFACE, 50, seed)) for seed in range(20)]
    assert np.mean(learnt) < 0.6 * np.mean(drawn)
    assert sum(a < b for a, b in zip(learnt, drawn)) >= 15


def test_settings_stay_in_their_ranges():
    for settings, _ in search.minimise(lambda s: s["l1"], search.RANGES, 40, 1):
        assert set(settings) == set(search.RANGES)
        assert all(low <= settings[n] <= high and type(settings[n]) is type(low) for n, (low, high) in search.RANGES.items())


@pytest.fixture(scope="module")
def matrix(make_panel):
    from shelfcast.operators.profile import feature_columns

    features = training.model_features(make_panel(160, (1, 2), ("GROCERY",)), horizon=14)
    return training.training_matrix(features, feature_columns(features))


SMALL = search.RANGES | {"rounds": (2, 3), "depth": (1, 2), "step": (0.2, 0.6)}


def test_trials_end_for_a_reason(matrix):
    rows = search.tune_boosters(matrix, trials=6, folds=2, at_once=6, ranges=SMALL).collect()
    assert [r["trial"] for r in rows] == [1, 2, 3, 4, 5, 6] and {r["ended"] for r in rows} == {"finished", "worse"}
    assert all(r["folds"] == (2 if r["ended"] == "finished" else 1) for r in rows)
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["ended"] == "finished" and set(json.loads(best[0]["settings"])) == set(search.RANGES)


def test_time_limit_and_too_few_dates(matrix):
    rows = search.tune_boosters(matrix, trials=50, folds=2, at_once=2, seconds=0.0, ranges=SMALL).collect()
    assert [(r["folds"], r["ended"]) for r in rows] == [(1, "time")] * 2
    assert search.tune_boosters(matrix, folds=500).count() == 0
