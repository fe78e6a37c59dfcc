from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.plans import boosting
from shelfcast.plans.boosting import Booster, Model, Tree


def sample(n, seed=1, features=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, features)), 2)
    mean = np.exp(0.8 * (x[:, 0] > 0) + 0.5 * x[:, 1] + 0.7 * (x[:, 2] > 1) * (x[:, 0] < 0))
    y = np.where(rng.random(n) < 0.2, 0.0, rng.gamma(2.0, mean / 2))
    return x, np.round(y, 3)


def frame(spark, x, y, block=None):
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(block[i]) if block is not None else 0) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, block int").repartition(4)


def fit(df, *boosters, **options):
    return boosting.fit(df, list(boosters), "x", "y", "block", ["id"], **options)


def brute_tree(b, bins, g, h, edges):
    """Plain best-first or depth-limited growth; children lists as (rows, feature, bin, left, right)."""
    def best(rows):
        found = (0.0, None, None)
        whole = b.worth(g[rows].sum(), h[rows].sum())
        for j in range(bins.shape[1]):
            for cut in range(len(edges[j])):
                left = rows[bins[rows, j] <= cut]
                right = rows[bins[rows, j] > cut]
                if not len(left) or not len(right) or h[left].sum() < b.min_weight or h[right].sum() < b.min_weight:
                    continue
                gain = (b.worth(g[left].sum(), h[left].sum()) + b.worth(g[right].sum(), h[right].sum()) - whole) / 2 - b.min_gain
                if gain > found[0] + 1e-9:
                    found = (gain, j, cut)
        return found

    leaves = [(np.arange(len(g)), 0)]
    splits = 0
    while b.leaves is None or len(leaves) < b.leaves:
        options = [(best(rows), k) for k, (rows, depth) in enumerate(leaves) if depth < b.depth]
        options = [o for o in options if o[0][0] > 0]
        if not options:
            break
        (_, j, cut), k = max(options, key=lambda o: o[0][0])
        rows, depth = leaves.pop(k)
        leaves += [(rows[bins[rows, j] <= cut], depth + 1), (rows[bins[rows, j] > cut], depth + 1)]
        splits += 1
    return [rows for rows, _ in leaves]


def brute_fit(b, x, y, edges):
    """Scores of the training rows after all rounds."""
    bins = boosting.to_bins(x.tolist(), edges)
    at = lambda values: np.sort(values)[max(int(np.ceil(b.quantile * len(values))) - 1, 0)]
    score = np.full(len(y), {"squared": y.mean(), "tweedie": np.log(y.mean()), "pinball": at(y)}[b.loss])
    for _ in range(b.rounds):
        g, h = b.slopes(y, score)
        step = np.zeros(len(y))
        for rows in brute_tree(b, bins, g, h, edges):
            step[rows] = at(y[rows] - score[rows]) if b.loss == "pinball" else -b.shrunk(g[rows].sum()) / (h[rows].sum() + b.l2)
        score += b.step * step
    return np.exp(score) if b.loss == "tweedie" else score


def predictions(model, df):
    rows = df.select("id", model.predict(F.col("x")).alias("p")).orderBy("id").collect()
    return {b.name: np.array([r["p"][b.name] for r in rows]) for b in model.boosters}


def test_trees_equal_brute_force(spark):
    """Four models at once, each as if it were trained alone by a plain trainer."""
    x, y = sample(200)
    df = frame(spark, x, y)
    boosters = [
        Booster("squared", "squared", rounds=3, depth=3, step=0.3),
        Booster("tweedie", power=1.3, rounds=3, depth=3, step=0.3, l1=0.5, min_gain=0.05, min_weight=3.0),
        Booster("p90", "pinball", quantile=0.9, rounds=2, depth=2, step=0.5),
        Booster("leafwise", "squared", rounds=2, depth=5, leaves=6, step=0.3),
    ]
    model = fit(df, *boosters, bins=8)
    found = predictions(model, df)
    for b in boosters:
        assert found[b.name] == pytest.approx(brute_fit(b, x, y, model.edges), rel=1e-9, abs=1e-9), b.name
    assert all(sum(f < 0 for f, n in zip(t.feature, range(len(t.feature))) if n in reached(t)) <= 6 for t in model.trees[3])


def reached(tree):
    found, queue = set(), [0]
    while queue:
        n = queue.pop()
        found.add(n)
        if tree.feature[n] >= 0:
            queue += [tree.left[n], tree.right[n]]
    return found


def test_losses_early_stop_and_coverage(spark, monkeypatch):
    """Tweedie beats squared loss on its deviance, quantiles cover their share, and training stops early."""
    monkeypatch.setattr(boosting, "STORE_EVERY", 4)
    x, y = sample(6000)
    block = np.repeat([0, 1, 2], 2000)
    df = frame(spark, x, y, block)
    common = {"rounds": 14, "depth": 3, "step": 0.3, "stop": (1,), "patience": 2}
    model = fit(
        df, Booster("tweedie", **common), Booster("squared", "squared", **common),
        *[Booster(f"p{q}", "pinball", quantile=q / 100, **common) for q in (10, 90)], Booster("sampled", rows=0.3, top_rows=0.2, **common),
    )
    found, held = predictions(model, df), block == 2
    assert all(len(t) <= 14 and len(t) < len(h) for t, h in zip(model.trees, model.history))
    deviance = {n: model.boosters[0].losses(y[held], np.log(np.maximum(found[n][held], 1e-3))).mean() for n in ("tweedie", "squared", "sampled")}
    flat = model.boosters[0].losses(y[held], np.full(2000, np.log(y[:2000].mean()))).mean()
    assert deviance["tweedie"] < deviance["squared"] and deviance["tweedie"] < flat and deviance["sampled"] < flat
    assert np.mean(y[held] <= found["p10"][held]) == pytest.approx(0.2, abs=0.05)  # a fifth of the labels are 0
    assert np.mean(y[held] <= found["p90"][held]) == pytest.approx(0.9, abs=0.03)
    pinball, fixed = model.boosters[3].losses(y[held], found["p90"][held]).mean(), np.quantile(y[:2000], 0.9)
    assert pinball < 0.95 * model.boosters[3].losses(y[held], np.full(2000, fixed)).mean()


def test_folds_in_one_pass_equal_fits_alone(spark):
    x, y = sample(300, 4)
    block = np.arange(300) % 3
    df = frame(spark, x, y, block)
    one, two = (Booster(f"f{k}", rounds=2, depth=2, train=blocks, stop=(2,)) for k, blocks in ((1, (0,)), (2, (0, 1))))
    both = fit(df, one, two, bins=8)
    assert both.trees[1] == fit(df.where("block != 5"), two, bins=8).trees[0]
    assert both.trees[0] != both.trees[1]


def test_saved_models_and_odd_values(spark):
    rows = [(1, [1.0, None], 1.0, 0), (2, [float("nan"), 2.0], 0.0, 0), (3, [3.0, 2.0], None, 0), (4, [4.0, 5.0], 9.0, 0), (4, [4.0, 5.0], 9.0, 0)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, block int")
    model = fit(df, Booster("t", rounds=2, depth=2, min_weight=0.1))
    again = Model.from_json(model.to_json())
    assert again == model
    assert predictions(again, df)["t"].tolist() == predictions(model, df)["t"].tolist()
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(0), Booster("t"))
    with pytest.raises(ValueError, match="negative"):
        fit(df.withColumn("y", F.col("y") - 5), Booster("t"))
    with pytest.raises(ValueError, match="unknown loss"):
        Booster("t", "huber")


def test_a_constant_label_grows_nothing(spark):
    x, _ = sample(50)
    assert fit(frame(spark, x, np.full(50, 3.0)), Booster("s", "squared", rounds=3)).trees == [[]]
    assert Tree().scores(np.zeros((2, 1), np.uint8)).tolist() == [0.0, 0.0]


def test_places_of_uneven_trees():
    """Rows in a leaf near the root stay there; pruned children are never reached."""
    tree = boosting.Tree()
    left, right = tree.split(0, 1, 3)
    inner, _ = tree.split(right, 0, 5)
    tree.split(inner, 2, 1)
    boosting.prune(tree, {0: 3.0, right: 2.0, inner: 1.0}, 3)
    bins = np.random.default_rng(5).integers(0, 8, (500, 3)).astype(np.uint8)
    expected = [left if b[1] <= 3 else tree.left[right] if b[0] <= 5 else tree.right[right] for b in bins]
    assert tree.places(bins).tolist() == expected
    assert boosting.Tree().places(bins).tolist() == [0] * 500


def test_copies_are_replaced(spark, monkeypatch):
    """However many trees are grown, one stored copy is kept at a time and none afterwards."""
    kept, dropped = [], []
    keep, drop = boosting.stored, boosting.drop_copy
    monkeypatch.setattr(boosting, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(boosting, "drop_copy", lambda s, path: dropped.append(path) or drop(s, path))
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    rows = spark.range(400).selectExpr("id", "array(double(id % 7), double(id % 5)) AS x", "double(id % 7 + id % 5) AS y", "0 AS block")
    model = boosting.fit(rows, [boosting.Booster("a", "squared", rounds=7, depth=2)], "x", "y", "block", ["id"])
    assert len(model.trees[0]) == 7 and len(kept) == 4
    assert dropped == [path for _, path in kept]
    assert not any(Path(path.removeprefix("file:")).exists() for path in dropped)


def test_binary_columns_are_read_in_place():
    """Slices and empty columns of stored rows come back as they were written."""
    values = np.arange(60, dtype=np.float64).reshape(12, 5)
    column = boosting._binary(values)
    assert (boosting._matrix(column.slice(3, 4), np.float64, 5) == values[3:7]).all()
    assert boosting._matrix(column.slice(0, 0), np.float64, 5).shape == (0, 5)
