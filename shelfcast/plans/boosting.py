"""Histogram boosting of trees on Spark, for several models in one pass.

Features are cut into quantile bins once and stored. A level of the current trees is one job: every
task adds up gradients, curvatures and row counts by (model, node, feature, bin) for its rows, the
partial histograms are summed by (model, node, feature) after one shuffle, the best split of each is
found there, and one row per model, node and feature reaches the driver. Models are grown side by
side, so point, quantile and fold models cost one scan a level, not one each. A model's own rows are
those of its blocks, for instance slices or folds.

Losses: ``squared``; ``tweedie``, the deviance of a Tweedie law under a log link; ``pinball``, whose
leaves take the quantile of their residuals. Trees grow level by level; with ``leaves`` set, only the
splits that a best-first order would make stay. Scores of earlier trees are worked out in the tasks
and stored anew every ``STORE_EVERY`` trees, in place of the copy before.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.plans.durable import drop_copy, stored

BINS = 64
STORE_EVERY = 5
#: Stored scores are cut to LARGEST_SCORE whenever so many trees were added since.
CUT_EVERY = 25
#: Features whose histograms move as one row.
PACK = 16
#: Relative error of the ranks behind bin edges and quantile leaves is one in so many.
ACCURACY = 10_000
LARGEST_SCORE = 30.0


@dataclass(frozen=True)
class Booster:
    """Settings of one model. ``train`` and ``stop`` are the blocks it learns from and stops early on."""

    name: str
    loss: str = "tweedie"
    power: float = 1.2
    quantile: float = 0.5
    train: tuple[int, ...] = (0,)
    stop: tuple[int, ...] = ()
    rounds: int = 100
    step: float = 0.1
    depth: int = 6
    leaves: int | None = None
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    top_rows: float = 0.0
    patience: int = 10
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("squared", "tweedie", "pinball"):
            raise ValueError(f"unknown loss {self.loss}")
        if not 1 < self.power < 2 or not 0 < self.quantile < 1 or not 0 < self.rows <= 1 or not 0 < self.columns <= 1 or not 0 <= self.top_rows < 1:
            raise ValueError(f"settings of {self.name} out of range")

    def allowed(self, features: int, tree: int) -> set[int]:
        """Features that a tree may split on: a seeded share of them, one at least."""
        order = np.random.default_rng((self.seed, tree)).permutation(features)
        return set(order[: max(1, round(self.columns * features))].tolist())

    def slopes(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the loss by the score."""
        if self.loss == "squared":
            return score - y, np.ones_like(y)
        if self.loss == "pinball":
            return np.where(y > score, -self.quantile, 1 - self.quantile), np.ones_like(y)
        low, high = np.exp((1 - self.power) * score), np.exp((2 - self.power) * score)
        return high - y * low, (2 - self.power) * high - (1 - self.power) * y * low

    def losses(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        if self.loss == "squared":
            return (y - score) ** 2
        if self.loss == "pinball":
            return np.maximum(self.quantile * (y - score), (self.quantile - 1) * (y - score))
        return np.exp((2 - self.power) * score) / (2 - self.power) - y * np.exp((1 - self.power) * score) / (1 - self.power)

    def shrunk(self, total):
        """Gradient sums after the L1 penalty."""
        return np.sign(total) * np.maximum(np.abs(total) - self.l1, 0)

    def worth(self, g, h):
        return self.shrunk(g) ** 2 / (h + self.l2)

    def sample(self, g: np.ndarray, u: np.ndarray, tree: int) -> np.ndarray:
        """Weight of each row in a tree: a share of rows, or all steep ones and a reweighted share of the others."""
        if self.rows == 1:
            return np.ones(len(g))
        mixed = (u ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        share = (mixed >> np.uint64(11)).astype(float) / float(1 << 53)
        if not self.top_rows or not len(g):
            return (share < self.rows).astype(float)
        steep = np.abs(g) >= np.quantile(np.abs(g), 1 - self.top_rows)
        rest = self.rows / (1 - self.top_rows)
        return np.where(steep, 1.0, np.where(share < rest, 1 / rest, 0.0))


@dataclass
class Tree:
    """Nodes by number: feature (-1 in a leaf), last bin of the left child, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        first = len(self.feature)
        for column, blank in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([blank, blank])
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, first, first + 1
        return first, first + 1

    def _depth(self) -> int:
        """Splits on the longest way from the root."""
        steps, level = 0, [0]
        while level := [c for n in level if self.feature[n] >= 0 for c in (self.left[n], self.right[n])]:
            steps += 1
        return steps

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row; rows that are in a leaf stay there while the others go on."""
        feature, cut, own = np.array(self.feature), np.array(self.bin), np.arange(len(self.feature))
        leaf = feature < 0
        child = np.stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)], axis=1).ravel()
        feature = np.where(leaf, 0, feature)
        flat, start = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), np.int64)
        for _ in range(self._depth()):
            right = flat.take(start + feature.take(node)) > cut.take(node)
            node = child.take(2 * node + right)
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(bins)]


@dataclass
class Model:
    """Bin edges of every feature, and for every booster its start score and trees."""

    boosters: list[Booster]
    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]]
    history: list[list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        found = json.loads(text)
        tuples = lambda b: b | {"train": tuple(b["train"]), "stop": tuple(b["stop"])}
        return cls(
            [Booster(**tuples(b)) for b in found["boosters"]], found["edges"], found["start"],
            [[Tree(**t) for t in trees] for trees in found["trees"]], found["history"],
        )

    def only(self, name: str) -> Model:
        """The model of one booster."""
        at = [b.name for b in self.boosters].index(name)
        lists = (self.start, self.trees, self.history)
        start, trees, history = ([x[at]] for x in lists)
        return Model([self.boosters[at]], self.edges, start, trees, history)

    def predict(self, features: Column) -> Column:
        """Struct of one prediction per booster, on the scale of the label."""
        model = self

        def run(rows: pd.Series) -> pd.DataFrame:
            bins = to_bins(rows.tolist(), model.edges)
            out = {}
            for b, start, trees in zip(model.boosters, model.start, model.trees):
                score = np.full(len(bins), start)
                for tree in trees:
                    score += tree.scores(bins)
                out[b.name] = np.exp(np.minimum(score, LARGEST_SCORE)) if b.loss == "tweedie" else score
            return pd.DataFrame(out)

        kind = T.StructType([T.StructField(b.name, T.DoubleType()) for b in self.boosters])
        return F.pandas_udf(run, kind)(features)


# binning -------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: str, count: int, bins: int = BINS) -> list[list[float]]:
    """Distinct inner quantiles of each feature; one bounded summary a feature."""
    shares = [k / bins for k in range(1, bins)]
    value = [F.nullif(F.get(F.col(features), j), F.lit(float("nan"))) for j in range(count)]
    found = rows.agg(*[F.percentile_approx(v, shares, ACCURACY).alias(f"e{j}") for j, v in enumerate(value)]).first()
    return [sorted(set(found[f"e{j}"] or [])) for j in range(count)]


def to_bins(rows, edges: list[list[float]]) -> np.ndarray:
    """Bin of every value; a value up to edge b is in a bin up to b, missing ones are in the first."""
    values = np.asarray(rows, float).reshape(len(rows), len(edges))
    out = np.empty(values.shape, np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, np.searchsorted(np.array(cuts), values[:, j], side="left"))
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The values that :func:`_binary` wrote, without a copy."""
    if not len(column):
        return np.zeros((0, width), kind)
    whole = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], whole)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


STORED = "block int, y double, u long, bins binary, scores binary"


def _stored(edges, start):
    """Task function: (block, y, u, features) to STORED."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            bins = to_bins(values.reshape(batch.num_rows, len(edges)), edges)
            scores = np.tile(np.array(start), (batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(bins), _binary(scores)], ["block", "y", "u", "bins", "scores"])

    return store


# growing -------------------------------------------------------------------------------------


@dataclass
class _Rows:
    """One batch with the scores of the trees so far."""

    block: np.ndarray
    y: np.ndarray
    u: np.ndarray
    bins: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, pending: list[list[Tree]], features: int, cut: bool = True) -> _Rows:
        block, y, u = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        bins = _matrix(batch.column(3), np.uint8, features)
        scores = _matrix(batch.column(4), np.float64, len(pending)).copy()
        for k, trees in enumerate(pending):
            for tree in trees:
                scores[:, k] += tree.scores(bins)
        return cls(block, y, u.view(np.uint64), bins, np.minimum(scores, LARGEST_SCORE) if cut else scores)


def _histograms(boosters, features, pending, growing, frontier, number, bins):
    """Task function: partial histograms (task, model, node, feature, sums); node -1 holds the loss on the stop blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((3, len(nodes), features, bins)) for k, nodes in frontier.items() if nodes}
        loss = {k: np.zeros(2) for k in frontier}
        needed = [trees if k in total else [] for k, trees in enumerate(pending)]
        for batch in batches:
            rows = _Rows.of(batch, needed, features)
            by_feature = np.ascontiguousarray(rows.bins.T)
            for k, sums in total.items():
                b = boosters[k]
                if growing[k].feature == [-1] and b.stop:
                    held = np.isin(rows.block, b.stop)
                    loss[k] += [b.losses(rows.y[held], rows.scores[held, k]).sum(), held.sum()]
                own = np.flatnonzero(np.isin(rows.block, b.train))
                g, h = b.slopes(rows.y[own], rows.scores[own, k])
                weight = b.sample(g, rows.u[own], number)
                number_of = np.full(len(growing[k].feature), -1)
                number_of[frontier[k]] = np.arange(len(frontier[k]))
                place = number_of.take(growing[k].places(rows.bins[own]))
                here = (weight > 0) & (place >= 0)
                own, g, h, first = own[here], (g * weight)[here], (h * weight)[here], place[here] * bins
                alike = bool((h == 1).all())  # curvatures are then the counts
                for j in range(features):
                    cell = first + by_feature[j].take(own)
                    rows_in = np.bincount(cell, minlength=len(frontier[k]) * bins).reshape(-1, bins)
                    sums[0, :, j] += np.bincount(cell, g, len(frontier[k]) * bins).reshape(-1, bins)
                    sums[1, :, j] += rows_in if alike else np.bincount(cell, h, len(frontier[k]) * bins).reshape(-1, bins)
                    sums[2, :, j] += rows_in
        out = [(k, -1, 0, loss[k].tobytes()) for k in total]
        for k, sums in total.items():
            packed = np.ascontiguousarray(sums.transpose(1, 2, 0, 3))  # node, feature, sum, bin
            for i, node in enumerate(frontier[k]):
                if packed[i, 0, 2].any():
                    out += [(k, node, j, packed[i, j : j + PACK].tobytes()) for j in range(0, features, PACK)]
        names = ["task", "model", "node", "feature", "sums"]
        columns = list(zip(*out)) if out else [(), (), (), ()]
        task = pa.array([TaskContext.get().partitionId()] * len(out), pa.int32())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([task, *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names)

    return add


def best_splits(b: Booster, sums: np.ndarray) -> np.ndarray:
    """Rows gain, last bin on the left, gradient and curvature sums left and right; gain 0 if no split is allowed.

    ``sums`` holds for each histogram gradients, curvatures and counts by bin.
    """
    left = np.cumsum(sums, axis=2)
    whole, left = left[:, :, -1:], left[:, :, :-1]
    rest = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (b.worth(left[:, 0], left[:, 1]) + b.worth(rest[:, 0], rest[:, 1]) - b.worth(whole[:, 0], whole[:, 1])) / 2 - b.min_gain
    allowed = (left[:, 1] >= b.min_weight) & (rest[:, 1] >= b.min_weight) & (left[:, 2] > 0) & (rest[:, 2] > 0)
    gain = np.where(allowed & np.isfinite(gain) & (gain > 0), gain, 0.0)
    if not gain.shape[1]:
        return np.zeros((len(sums), 6))
    at, each = gain.argmax(axis=1), np.arange(len(sums))
    return np.stack([gain[each, at], at, left[each, 0, at], left[each, 1, at], rest[each, 0, at], rest[each, 1, at]], axis=1)


SPLITS = "model int, node int, feature int, gain double, at int, gl double, hl double, gr double, hr double"


def _splits(boosters, bins):
    """Task function: sums of the partial histograms of a key, in the order of their tasks, and the best split of each feature."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            task, *key, sums = (c.to_pylist() for c in batch.columns)
            for t, k, s in zip(task, zip(*key), sums):
                total.setdefault(k, []).append((t, s))
        out = [np.zeros((0, 9))]
        for (k, node, first), parts in total.items():
            parts.sort(key=lambda p: p[0])
            sums = np.add.reduce([np.frombuffer(s) for _, s in parts])
            if node < 0:
                out.append(np.array([[k, node, first, sums[0], 0, sums[1], 0, 0, 0]], float))
                continue
            found = best_splits(boosters[k], sums.reshape(-1, 3, bins))
            lead = np.stack([np.full(len(found), k), np.full(len(found), node), first + np.arange(len(found))], axis=1)
            out.append(np.concatenate([lead, found], axis=1))
        rows = np.concatenate(out)
        kinds = [(c.split()[0], pa.int32() if c.endswith("int") else pa.float64()) for c in SPLITS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]).cast(kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return find


def _residuals(boosters, features, pending, growing):
    """Task function: (model, leaf, residual) of the training rows of quantile models."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = [trees if k in growing else [] for k, trees in enumerate(pending)]
        for batch in batches:
            rows = _Rows.of(batch, needed, features)
            for k, tree in growing.items():
                own = np.flatnonzero(np.isin(rows.block, boosters[k].train))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), k, np.int32)), pa.array(tree.places(rows.bins[own]).astype(np.int32)),
                        pa.array(rows.y[own] - rows.scores[own, k]),
                    ],
                    ["model", "leaf", "residual"],
                )

    return take


def _advanced(features, pending, cut):
    """Task function: stored rows with the pending trees added to their scores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows.of(batch, pending, features, cut)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _binary(rows.scores)], batch.schema.names)

    return add


def prune(tree: Tree, gains: dict[int, float], leaves: int) -> None:
    """Keep the splits that best-first growth would make until the tree has so many leaves."""
    queue, kept = [(-gains[0], 0)] if 0 in gains else [], set()
    while queue and len(kept) + 1 < leaves:
        _, node = heapq.heappop(queue)
        kept.add(node)
        for child in (tree.left[node], tree.right[node]):
            if child in gains:
                heapq.heappush(queue, (-gains[child], child))
    for node in gains:
        if node not in kept:
            tree.feature[node] = -1


class _Fit:
    """The growing state of one ``fit``."""

    def __init__(self, rows: DataFrame, boosters: list[Booster], edges, start):
        self.boosters, self.features = boosters, len(edges)
        self.rows, self.copy = stored(rows.mapInArrow(_stored(edges, start), STORED))
        self.bins = max([len(e) for e in edges], default=0) + 1
        self.trees: list[list[Tree]] = [[] for _ in boosters]
        self.pending: list[list[Tree]] = [[] for _ in boosters]
        self.uncut = [0 for _ in boosters]
        self.history: list[list[float]] = [[] for _ in boosters]
        self.active = set(range(len(boosters)))

    def _level(self, growing, frontier, number) -> dict[tuple[int, int], tuple]:
        parts = self.rows.mapInArrow(
            _histograms(self.boosters, self.features, self.pending, growing, frontier, number, self.bins),
            "task int, model int, node int, feature int, sums binary",
        )
        found = parts.repartition("model", "node", "feature").mapInArrow(_splits(self.boosters, self.bins), SPLITS)
        best: dict[tuple[int, int], tuple] = {}
        allowed = {k: self.boosters[k].allowed(self.features, number) for k in growing}
        for r in sorted(found.collect(), key=lambda r: (r["model"], r["node"], r["feature"])):  # one row a model, node and feature
            if r["node"] < 0:
                if r["gl"]:
                    self.history[r["model"]].append(r["gain"] / r["gl"])
            elif r["feature"] in allowed[r["model"]]:
                at = r["model"], r["node"]
                if at not in best or r["gain"] > best[at]["gain"]:
                    best[at] = r
        return best

    def _stopped(self, k: int) -> bool:
        """Has the loss on the stop blocks not fallen for ``patience`` rounds?"""
        seen = self.history[k]
        return len(seen) > self.boosters[k].patience and int(np.argmin(seen)) < len(seen) - self.boosters[k].patience

    def grow(self, number: int) -> None:
        """One more tree of every active model."""
        growing = {k: Tree() for k in self.active}
        frontier = {k: [0] for k in self.active}
        gains: dict[int, dict[int, float]] = {k: {} for k in self.active}
        sums: dict[int, dict[int, tuple[float, float]]] = {k: {} for k in self.active}
        for level in range(max(self.boosters[k].depth for k in self.active)):
            best = self._level(growing, frontier, number)
            if level == 0:
                for k in [k for k in self.active if self._stopped(k)]:
                    self.active.discard(k)
                    del growing[k]
            nxt: dict[int, list[int]] = {k: [] for k in growing}
            for k, tree in growing.items():
                for node in frontier[k]:
                    r = best.get((k, node))
                    if r is None or r["gain"] <= 0:
                        continue
                    gains[k][node] = r["gain"]
                    children = tree.split(node, r["feature"], r["at"])
                    sums[k] |= {children[0]: (r["gl"], r["hl"]), children[1]: (r["gr"], r["hr"])}
                    # A node without twice the least weight can't be split.
                    nxt[k] += [n for n in children if sums[k][n][1] >= 2 * self.boosters[k].min_weight]
                if level + 1 >= self.boosters[k].depth:
                    nxt[k] = []
            frontier = nxt
            if not any(frontier.values()):
                break
        for k, tree in growing.items():
            if not gains[k]:
                self.active.discard(k)
                continue
            b = self.boosters[k]
            if b.leaves:
                prune(tree, gains[k], b.leaves)
            for node, (g, h) in sums[k].items():
                tree.value[node] = float(-b.step * b.shrunk(g) / (h + b.l2))
        self._quantile_leaves({k: t for k, t in growing.items() if gains[k] and self.boosters[k].loss == "pinball"})
        for k, tree in growing.items():
            if gains[k]:
                self.trees[k].append(tree)
                self.pending[k].append(tree)
                self.uncut[k] += 1
        if self.active and max(map(len, self.pending)) >= STORE_EVERY:
            cut, before = max(self.uncut) >= CUT_EVERY, self.copy
            self.rows, self.copy = stored(self.rows.mapInArrow(_advanced(self.features, self.pending, cut), STORED))
            drop_copy(self.rows.sparkSession, before)
            self.pending = [[] for _ in self.boosters]
            if cut:
                self.uncut = [0 for _ in self.boosters]

    def _quantile_leaves(self, growing: dict[int, Tree]) -> None:
        if not growing:
            return
        taken = self.rows.mapInArrow(
            _residuals(self.boosters, self.features, self.pending, growing), "model int, leaf int, residual double"
        )
        share = F.lit(None)
        for k in growing:
            share = F.when(F.col("model") == k, F.lit(self.boosters[k].quantile)).otherwise(share)
        shares = sorted({self.boosters[k].quantile for k in growing})
        found = taken.groupBy("model", "leaf").agg(F.percentile_approx("residual", shares, ACCURACY).alias("q"))
        for r in found.collect():  # one row a leaf
            b = self.boosters[r["model"]]
            growing[r["model"]].value[r["leaf"]] = b.step * r["q"][shares.index(b.quantile)]


def _start(rows: DataFrame, boosters: list[Booster]) -> list[float]:
    """Best constant score of each model's training rows."""
    y, own = F.col("y"), [F.col("block").isin(*b.train) for b in boosters]
    aggregates = [
        F.percentile_approx(F.when(o, y), b.quantile, ACCURACY) if b.loss == "pinball" else F.avg(F.when(o, y))
        for b, o in zip(boosters, own)
    ]
    found = rows.agg(*[a.cast("double").alias(f"s{k}") for k, a in enumerate(aggregates)]).first()
    out = []
    for b, value in zip(boosters, found):
        if value is None:
            raise ValueError(f"{b.name} has no rows to train on")
        out.append(float(np.log(max(value, 1e-9))) if b.loss == "tweedie" else float(value))
    return out


def fit(rows: DataFrame, boosters: list[Booster], features: str, label: str, block: str, keys: list[str], bins: int = BINS,
        until: float | None = None) -> Model:
    """Train all ``boosters`` side by side on ``rows``.

    ``features`` is an array column of doubles, as long in every row; a missing value goes to the first
    bin. ``block`` is an integer column that says which models learn from a row or stop on it, and
    ``keys`` decide a row's place in samples. Rows without a label are left out; a Tweedie label must not be
    negative. Trees after the round with the least loss on the stop blocks are dropped. No tree is begun after
    the time ``until`` (of ``time.monotonic``).
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    used = sorted({n for b in boosters for n in (*b.train, *b.stop)})
    known = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")) & F.col(block).isin(*used))
    raw = known.select(
        F.col(block).cast("int").alias("block"), F.col(label).cast("double").alias("y"), F.xxhash64(*keys).alias("u"),
        F.col(features).alias("features"),
    )
    start = _start(raw, boosters)
    if any(b.loss == "tweedie" for b in boosters) and raw.where("y < 0").limit(1).count():
        raise ValueError("a Tweedie label must not be negative")
    count = raw.select(F.size("features")).first()[0]
    edges = bin_edges(raw.where(F.col("block").isin(*{n for b in boosters for n in b.train})), "features", count, bins)
    fitting = _Fit(raw, boosters, edges, start)
    number = 0
    while fitting.active and (until is None or time.monotonic() < until):
        fitting.active -= {k for k in fitting.active if number >= boosters[k].rounds}
        if fitting.active:
            fitting.grow(number)
        number += 1
    drop_copy(rows.sparkSession, fitting.copy)
    for k, b in enumerate(boosters):
        if b.stop and fitting.history[k]:
            del fitting.trees[k][int(np.argmin(fitting.history[k])) :]
    return Model(list(boosters), edges, start, fitting.trees, fitting.history)
