"""Integer k-means whose exact distances are prepared by n-simplex bounds.

Some of the starting vectors are pivots. Each vector's distances to them are worked out once; with the
pivots as the base of a simplex, they place the vector as its apex: coordinates in the space that the
pivots span and an altitude above it. The apex of a centroid is found in the same way each round. Two
apexes with altitudes g and h, whose feet are at distance b, belong to points whose distance is at
least sqrt(b^2 + (g - h)^2) and at most sqrt(b^2 + (g + h)^2). A centroid whose lower bound is above
another one's upper bound can't be the nearest; exact integer distances are taken for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import quoted
from shelfcast.plans.durable import durable

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 8
#: Largest absolute component after scaling; squared distances of such vectors fit 64-bit integers.
MOST = 1 << 25
#: A pivot whose squared altitude over the earlier ones is a smaller share of its squared distance is left out.
LEAST_ALTITUDE = 1e-4
#: Bounds are floating point numbers; this share of the squared distances covers their rounding.
SLACK = 1e-7
ROWS_AT_ONCE = 16_384


def _integers(vectors: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and their integer components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False) == dimensions)
    values = vectors.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    places = np.asarray(vectors.offsets)[rows][:, None] + np.arange(dimensions)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values[places] * scale)
        usable = (np.isfinite(scaled) & (np.abs(scaled) <= MOST)).all(axis=1)
    return rows[usable], scaled[usable].astype(np.int32)


def _as_binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(matrix)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _as_matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def squared_distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = vectors.astype(np.int64) - point
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Base:
    """Pivots, and the lower triangular coordinates of all but the first relative to the first."""

    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Base:
        """The simplex of these vectors, without those that lie nearly in the space of the earlier ones."""
        kept, corners = [vectors[0]], np.zeros((0, 0))
        for v in vectors[1:]:
            base = cls(np.array(kept), corners)
            apex = base.apex(v[None, :])[0]
            distance = float(squared_distances(v[None, :], kept[0])[0])
            if distance and apex[-1] ** 2 > LEAST_ALTITUDE * distance:
                corners = np.block([[corners, np.zeros((len(corners), 1))], [apex[None, :]]])
                kept.append(v)
        return cls(np.array(kept), corners)

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates of each vector in the base, its altitude last."""
        squared = np.stack([squared_distances(vectors, p) for p in self.pivots], axis=1).astype(float)
        sides = (self.corners**2).sum(axis=1)
        right = (squared[:, :1] + sides - squared[:, 1:]) / 2
        foot = np.zeros_like(right)
        for k, corner in enumerate(self.corners):
            foot[:, k] = (right[:, k] - (foot[:, :k] * corner[:k]).sum(axis=1)) / corner[k]
        altitude = np.sqrt(np.maximum(squared[:, 0] - (foot**2).sum(axis=1), 0))
        return np.concatenate([foot, altitude[:, None]], axis=1)


def candidates(apex: np.ndarray, centroid_apex: np.ndarray) -> np.ndarray:
    """Boolean matrix: may the centroid be nearest to the vector, by the bounds?"""
    foot, altitude = apex[:, :-1], apex[:, -1:]
    low = np.empty((len(apex), len(centroid_apex)))
    high = np.empty_like(low)
    scale = (apex**2).sum(axis=1)
    for c, point in enumerate(centroid_apex):
        gap = ((foot - point[:-1]) ** 2).sum(axis=1)
        slack = SLACK * (scale + (point**2).sum()) + SLACK
        low[:, c] = gap + (altitude[:, 0] - point[-1]) ** 2 - slack
        high[:, c] = gap + (altitude[:, 0] + point[-1]) ** 2 + slack
    return low <= high.min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, apex: np.ndarray, centroids: np.ndarray, base: Base) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of a tie) and the exact squared distance."""
    possible = candidates(apex, base.apex(centroids))
    exact = np.full(possible.shape, np.iinfo(np.int64).max)
    for c, point in enumerate(centroids):
        rows = np.flatnonzero(possible[:, c])
        exact[rows, c] = squared_distances(vectors[rows], point)
    cluster = exact.argmin(axis=1)
    return cluster, exact[np.arange(len(exact)), cluster]


def _kept(dimensions: int, scale: int):
    """Task function: usable rows (id, vector) as (id, integers)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = _integers(batch.column(1), dimensions, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _as_binary(matrix)], ["id", "v"])

    return keep


def _placed(base: Base, dimensions: int):
    """Task function: (id, integers) with the apex coordinates added."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = base.apex(_as_matrix(batch.column(1), np.int32, dimensions))
            yield pa.RecordBatch.from_arrays([*batch.columns, _as_binary(apex)], ["id", "v", "apex"])

    return place


def _assigned(base: Base, centroids: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _as_matrix(batch.column("v"), np.int32, centroids.shape[1])
    apex = _as_matrix(batch.column("apex"), np.float64, len(base.pivots))
    return vectors, *nearest(vectors, apex, centroids, base)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _sums(base: Base, centroids: np.ndarray):
    """Task function: componentwise sums and counts of the task's vectors by nearest centroid."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape, np.int64)
        count = np.zeros(len(centroids), np.int64)
        for part in _pieces(batches):
            vectors, cluster, _ = _assigned(base, centroids, part)
            np.add.at(total, cluster, vectors)
            count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    return add


def _labels(base: Base, centroids: np.ndarray):
    """Task function: id, cluster and exact distance."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            _, cluster, distance = _assigned(base, centroids, part)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )

    return label


def _moved(placed: DataFrame, base: Base, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; those without vectors stay."""
    parts = placed.select("v", "apex").mapInArrow(_sums(base, centroids), "cluster int, n long, total array<long>")
    wide = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("total").alias("place", "x"))
    sums = wide.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # one row a centroid and component
        out[r["cluster"], r["place"]] = int(r["x"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            seed: int = 1, dimensions: int = DIMENSIONS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """One row per usable vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector is usable if it has exactly ``dimensions`` components, none null or non-finite; a component
    x becomes floor(scale * x). Vectors with a component beyond 2^25 after that are not usable, as their
    distances fit no 64-bit integer. Centroids start as the k vectors with the smallest lowercase-hex
    SHA-256 of ``seed:id``; ties (repeated ids) are broken by the components, a null id counts as empty.
    Repeated rows count each. Fewer usable vectors than k make fewer centroids, none give no rows. ``k``
    centroids of ``dimensions`` integers go to every task.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    fields = [T.StructField("id", kind), T.StructField("v", T.BinaryType())]
    kept = durable(rows.mapInArrow(_kept(dimensions, scale), T.StructType(fields)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    result = f"{quoted('id')} {kind.simpleString()}, cluster int, distance long"
    out = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not starts:
        empty = spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty.select(F.col("id").alias(id_col), *out)
    centroids = np.array([np.frombuffer(r["v"], np.int32) for r in starts], np.int64)
    base = Base.of(centroids[:pivots])
    placed = durable(kept.mapInArrow(_placed(base, dimensions), T.StructType([*fields, T.StructField("apex", T.BinaryType())])))
    for _ in range(rounds):
        centroids = _moved(placed, base, centroids)
    labels = durable(placed.mapInArrow(_labels(base, centroids), result))
    sums = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    total = sum(r["inertia"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(r["cluster"], int(r["inertia"]), int(total), digests[r["cluster"]]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row a centroid.
    return labels.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *out)
