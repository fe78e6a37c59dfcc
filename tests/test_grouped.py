import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import grouped


def hot_rows(seed=5, n=600):
    """A third of all rows in one group, null keys and values, one group of one row."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None])
        rows.append((key, i, None if rnd.random() < 0.2 else float(rnd.randint(0, 50)), rnd.choice([0, 1, 1, 2, None])))
    return [*rows, ("single", n, 1.0, 1)]


SCHEMA = "key string, place int, value double, promo int"


def by_group(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(hot_rows(), SCHEMA).repartition(7)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_rolling_over_ranges(table, parts):
    out = grouped.scan_groups(table, ["key"], ["place"], ["value"], grouped.rolling("value", 9, "own"), parts)
    found = {r.place: r for r in out.collect()}
    assert len(found) == 601
    for rows in by_group(hot_rows()).values():
        values = pd.Series([np.nan if r[2] is None else r[2] for r in rows])
        for name in ("mean", "std", "min", "max"):
            wanted = getattr(values.rolling(9, min_periods=1), name)()
            for row, w in zip(rows, wanted):
                got = found[row[1]][f"own_{name}"]
                assert (got is None and np.isnan(w)) or got == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_since_event_over_ranges(table, parts):
    out = grouped.scan_groups(table, ["key"], ["place"], ["promo"], grouped.since_event("promo", "since", "streak"), parts)
    found = {r.place: (r.since, r.streak) for r in out.collect()}
    for rows in by_group(hot_rows()).values():
        event = plain = 0
        for at, row in enumerate(rows, 1):
            event, plain = (at, plain) if row[3] == 1 else (event, at)
            assert found[row[1]] == (at - event, at - plain)


def test_a_group_is_never_whole_in_one_call(table):
    """Ranges cut the hot group, so the longest stretch is a range, not the group."""
    longest = table.sparkSession.sparkContext.accumulator(0, Longest())
    plain = grouped.rolling("value", 3, "own")

    def summary(rows):
        longest.add(len(rows))
        return plain.summary(rows)

    scan = grouped.Scan(plain.state, plain.result, summary, plain.merge, plain.apply)
    assert grouped.scan_groups(table, ["key"], ["place"], ["value"], scan, 12).count() == 601
    assert 0 < longest.value < 120


class Longest:
    def zero(self, value):
        return value

    def addInPlace(self, one, other):
        return max(one, other)


def test_scan_keeps_columns_and_replaces_its_own(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 9.0, "x"), (1, 2, 4.0, 9.0, "y")], "k int, place int, value double, own_mean double, b string")
    out = grouped.scan_groups(df, ["k"], ["place"], ["value"], grouped.rolling("value", 2, "own"))
    assert [(r.b, r.own_mean) for r in out.orderBy("place").collect()] == [("x", 2.0), ("y", 3.0)]


def test_scan_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grouped.scan_groups(empty, ["key"], ["place"], ["value"], grouped.rolling("value", 2, "own")).collect() == []


AGGREGATE = grouped.joined_values({"word": "words"}, {"flag": "any_flag"})


def test_aggregate_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", None]), rnd.choice(["u", "v", None]), rnd.choice([None, False]) if i else True)
            for i in range(300)]
    df = spark.createDataFrame(rows, "key string, word string, flag boolean").repartition(9)
    out = {r.key: (r.words, r.any_flag) for r in grouped.aggregate_groups(df, ["key"], ["word", "flag"], AGGREGATE).collect()}
    assert out == {"hot": ("u;v", 1), "a": ("u;v", 0), None: ("u;v", 0)}


def test_aggregate_lets_groups_out(spark):
    """More groups than a task may hold open."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(1000).select((F.col("id") % 97).alias("key"), F.lit("w").alias("word"), (F.col("id") == 5).alias("flag"))
        found = {r.key: r.any_flag for r in grouped.aggregate_groups(df, ["key"], ["word", "flag"], AGGREGATE, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k: int(k == 5) for k in range(97)}


def test_aggregate_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "key string, word string, flag boolean")
    assert grouped.aggregate_groups(empty, ["key"], ["word", "flag"], AGGREGATE).collect() == []
