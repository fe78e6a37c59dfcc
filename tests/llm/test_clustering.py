import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import clustering
from shelfcast.llm.queries import op13_centroid_clustering

COLUMNS = "vec_id long, embedding array<double>"


def brute(rows, k=16, rounds=3, dimensions=64, scale=64):
    """Rows of the operator from (id, vector), in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(scale * x) for x in v]
            if all(abs(x) <= 1 << 25 for x in ints):
                kept.append((i, ints))
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept)
    centroids = [v for _, _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    out = []
    for i, c, d in found:
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((i, c, d, sum(e for _, b, e in found if b == c), total, digest))
    return sorted(out, key=str)


def clustered(df, **options):
    return sorted((tuple(r) for r in clustering.cluster(df, **options).collect()), key=str)


def some_rows(n, groups=5, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (groups, 64))
    return [(i, (centres[0 if i % 3 == 0 else i % groups] + rng.normal(0, spread, 64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.5])
def test_brute_force(spark, spread):
    rows = some_rows(300, spread=spread)
    assert clustered(spark.createDataFrame(rows, COLUMNS).repartition(6)) == brute(rows)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op13_centroid_clustering(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    v = [0.25] * 64
    rows = [
        *some_rows(20), (100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 65), (104, [None, *v[1:]]), (105, [math.nan, *v[1:]]),
        (106, [math.inf, *v[1:]]), (107, [1e300, *v[1:]]), (108, [1e6, *v[1:]]), (109, v), (109, v), (110, v), (None, v), (None, [-x for x in v])]
    df = spark.createDataFrame(rows, COLUMNS)
    assert clustered(df) == brute(rows)
    assert {r[0] for r in clustered(df)}.isdisjoint(range(100, 108))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i // 2)] * 64) for i in range(n)]
    assert clustered(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, [0.5])], COLUMNS)
    found = clustering.cluster(df)
    assert found.count() == 0 and found.columns[0] == "vec_id"
    assert clustering.cluster(df.limit(0)).count() == 0


def test_clashing_columns_and_string_ids(spark):
    rows = some_rows(40)
    df = spark.createDataFrame([(str(i), v) for i, v in rows], "vec_id string, embedding array<double>")
    df = df.withColumn("Cluster", F.lit(1)).withColumn("v", F.lit(2)).withColumn("a.b", F.lit(3))
    assert clustered(df) == sorted(((str(r[0]), *r[1:]) for r in brute(rows)), key=str)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (16, 64))
    vectors = (centres[rng.integers(0, 16, 3000)] + rng.integers(-5, 6, (3000, 64))).astype(np.int32)
    base = clustering.Base.of(centres[:8])
    apex, ends = base.apex(vectors), base.apex(centres)
    exact = np.stack([clustering.squared_distances(vectors, c) for c in centres], axis=1)
    for c in range(16):
        gap = ((apex[:, :-1] - ends[c, :-1]) ** 2).sum(axis=1)
        assert (gap + (apex[:, -1] - ends[c, -1]) ** 2 <= exact[:, c] * (1 + 1e-9) + 1e-6).all()
        assert (gap + (apex[:, -1] + ends[c, -1]) ** 2 >= exact[:, c] * (1 - 1e-9) - 1e-6).all()
    possible = clustering.candidates(apex, ends)
    assert possible[np.arange(3000), exact.argmin(axis=1)].all() and possible.mean() < 0.5


def test_equal_pivots_are_left_out():
    same = np.array([[1, 2, 3], [1, 2, 3], [2, 4, 6], [3, 6, 9]])
    assert len(clustering.Base.of(same).pivots) == 2
