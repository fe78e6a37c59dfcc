"""A search for booster settings that learns from its trials.

Settings are proposed by a tree-structured Parzen estimator: each setting's values in good trials and
in the others are smoothed into two densities, values are drawn from the good one, and the draw with
the largest ratio of the two is tried next. The trials of a generation are trained side by side, one
expanding fold after another; after each fold the ones worse than the median of all trials that got as
far stop.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import replace
from statistics import median

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.plans import boosting
from shelfcast.plans.folds import expanding_folds, split_dates
from shelfcast.plans.training import FEATURES, LABEL, STOP_SHARE, TRIALS, learners

# Search ranges, whole numbers where both ends are; the step is drawn on a log scale.
RANGES = {
    "rounds": (100, 2000),
    "depth": (3, 10),
    "step": (0.01, 0.3),
    "rows": (0.6, 1.0),
    "columns": (0.6, 1.0),
    "l1": (0.0, 2.0),
    "l2": (0.0, 2.0),
    "min_weight": (1, 7),
    "min_gain": (0.0, 0.4),
}
ON_LOG_SCALE = ("step",)
RANDOM_TRIALS = 10
GOOD_SHARE = 0.2
DRAWS = 32
AT_ONCE = 5
#: A rung stops no trial before so many have reached it.
LEAST_AT_RUNG = 4


def _to_unit(name: str, value: float, low: float, high: float) -> float:
    if name in ON_LOG_SCALE:
        value, low, high = math.log(value), math.log(low), math.log(high)
    return (value - low) / (high - low)


def _from_unit(name: str, unit: float, low: float, high: float):
    if name in ON_LOG_SCALE:
        return float(math.exp(math.log(low) + unit * (math.log(high) - math.log(low))))
    if isinstance(low, int) and isinstance(high, int):
        return int(round(low + unit * (high - low)))
    return float(low + unit * (high - low))


def _density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of a uniform density and one bell around each point, as wide as the points are sparse."""
    width = max(1 / (1 + len(points)), 0.05)
    bells = np.exp(-(((at[:, None] - points) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi))
    return (1 + bells.sum(axis=1)) / (1 + len(points))


def propose(done: list[tuple[dict, float]], ranges: dict, rng: np.random.Generator) -> dict:
    """Next settings, given those tried and their losses."""
    ranked = sorted((d for d in done if math.isfinite(d[1])), key=lambda d: d[1])
    out, many = {}, math.ceil(GOOD_SHARE * len(ranked))
    for name, (low, high) in ranges.items():
        if len(ranked) < RANDOM_TRIALS:
            out[name] = _from_unit(name, rng.random(), low, high)
            continue
        units = np.array([_to_unit(name, s[name], low, high) for s, _ in ranked])
        good, other = units[:many], units[many:]
        near = rng.integers(-1, many, DRAWS)  # -1 draws from the uniform part
        width = max(1 / (1 + many), 0.05)
        draws = np.where(near < 0, rng.random(DRAWS), good[near] + rng.normal(0, width, DRAWS))
        draws = np.clip(draws, 0, 1)
        best = draws[int(np.argmax(_density(good, draws) / _density(other, draws)))]
        out[name] = _from_unit(name, float(best), low, high)
    return out


def minimise(loss: Callable[[dict], float], ranges: dict, trials: int, seed: int = 42) -> list[tuple[dict, float]]:
    """Trials of a loss that is cheap to evaluate, one after another."""
    rng, done = np.random.default_rng(seed), []
    for _ in range(trials):
        settings = propose(done, ranges, rng)
        done.append((settings, loss(settings)))
    return done


def tune_boosters(matrix: DataFrame, trials: int = TRIALS, folds: int = 3, at_once: int = AT_ONCE, seconds: float | None = None,
                  seed: int = 42, ranges: dict | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Trial table: trial, settings, wmape (mean over the folds tried), folds, ended, is_best.

    ``ended`` is ``finished``, ``worse`` (than the median at a rung) or ``time``: after ``seconds`` no
    further tree is begun, and trials with folds left end. Only finished trials can be the best. A matrix
    with too few dates for the folds gives no rows.
    """
    spark, day, ranges = matrix.sparkSession, F.col(cols.date), ranges or RANGES
    schema = "trial int, settings string, wmape double, folds int, ended string"
    until = None if seconds is None else time.monotonic() + seconds
    late = lambda: until is not None and time.monotonic() >= until
    cuts = expanding_folds(matrix, folds, cols)
    if not cuts:
        return spark.createDataFrame([], schema).withColumn("is_best", F.lit(False))
    stops = [split_dates(f.train(matrix, cols.date), [1 - STOP_SHARE], cols)[0] for f in cuts]
    rng, done, table = np.random.default_rng(seed), [], []
    reached: list[list[float]] = [[] for _ in cuts]
    while len(table) < trials and not (table and late()):
        generation = [propose(done, ranges, rng) for _ in range(min(at_once, trials - len(table)))]
        scores: list[list[float]] = [[] for _ in generation]
        ended = ["finished"] * len(generation)
        for rung, (fold, stop) in enumerate(zip(cuts, stops)):
            running = [k for k in range(len(generation)) if ended[k] == "finished"]
            if rung and late():
                for k in running:
                    ended[k] = "time"
                break
            base = learners()[0]
            boosters = [replace(base, name=f"t{k}", **generation[k]) for k in running]
            block = F.when(day <= F.lit(stop), 0).when(day <= F.lit(fold.cutoff), 1).otherwise(2)
            rows = matrix.withColumn("_block", block).withColumn("_x", vector_to_array(FEATURES))
            model = boosting.fit(rows, boosters, "_x", LABEL, "_block", list(cols.grain), until=until)
            tested = fold.test(rows, cols.date).select(LABEL, model.predict(F.col("_x")).alias("_m"))
            found = tested.agg(*[
                (F.sum(F.abs(F.col(LABEL) - F.col(f"_m.t{k}"))) / F.greatest(F.sum(F.abs(LABEL)), F.lit(1e-9)) * 100).alias(f"t{k}")
                for k in running
            ]).first()
            for k in running:
                scores[k].append(float(found[f"t{k}"]))
                reached[rung].append(float(np.mean(scores[k])))
            if rung + 1 < len(cuts) and len(reached[rung]) >= LEAST_AT_RUNG:
                for k in running:
                    if np.mean(scores[k]) > median(reached[rung]):
                        ended[k] = "worse"
        for settings, own, why in zip(generation, scores, ended):
            done.append((settings, float(np.mean(own))))
            table.append((len(table) + 1, json.dumps(settings), float(np.mean(own)), len(own), why))
    rank = F.struct(F.col("ended") != "finished", "wmape", "trial")
    best = F.min_by("trial", rank).over(Window.partitionBy())  # one row per trial
    return spark.createDataFrame(table, schema).withColumn("is_best", F.col("trial") == best)
