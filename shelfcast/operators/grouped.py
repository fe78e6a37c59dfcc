"""Own Python callables over groups: mergeable aggregates and passes over ordered rows.

Both work on stretches of a group, never on a whole one: a stretch gives a small state, and states
of neighbouring stretches are merged. So a group of any size is spread over many tasks, and a task
holds one Arrow batch and one state per open group. Where built-in functions can say the same they
are faster; these are for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfcast.operators.ordering import RANGE, null_safe_equal, range_ids

STATE = "_state"
OPEN_GROUPS = 20_000
SALTS = 64
OUT_ROWS = 10_000


@dataclass(frozen=True)
class Aggregate:
    """A mergeable aggregate.

    ``update`` turns some rows of a group into a state (a dict with the fields of the schema
    ``state``), ``merge`` joins two states in any order, ``finish`` gives the result (a dict with the
    fields of ``result``).
    """

    state: str
    result: str
    update: Callable[[pd.DataFrame], dict]
    merge: Callable[[dict, dict], dict]
    finish: Callable[[dict], dict]


@dataclass(frozen=True)
class Scan:
    """A pass over the ordered rows of a group.

    ``summary`` turns a stretch of rows into a state, ``merge(earlier, later)`` joins the states of
    neighbouring stretches, and ``apply(before, rows)`` gives the new columns of a stretch (a dict of
    arrays with the fields of ``result``) from the state of all earlier rows, None if there are none.
    """

    state: str
    result: str
    summary: Callable[[pd.DataFrame], dict]
    merge: Callable[[dict, dict], dict]
    apply: Callable[[dict | None, pd.DataFrame], dict]


def _fields(df: DataFrame, names) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _keys(batch: pa.RecordBatch, names) -> list[tuple]:
    return list(zip(*[batch.column(n).to_pylist() for n in names]))


def _runs(keys: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first, end) of each run of equal neighbours."""
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


# aggregates ----------------------------------------------------------------------------------


def _partial(agg: Aggregate, keys: list[str], columns: list[str], schema: pa.Schema, open_groups: int):
    """Task function: one state per group and task; all go out when too many groups are open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(_keys(batch, keys)):
                places.setdefault(key, []).append(i)
            values = batch.select(columns).to_pandas()
            for key, at in places.items():
                state = agg.update(values.iloc[at])
                held[key] = agg.merge(held[key], state) if key in held else state
            if len(held) > open_groups:
                yield _rows([(*k, s) for k, s in held.items()], schema)
                held = {}
        if held:
            yield _rows([(*k, s) for k, s in held.items()], schema)

    return work


def _merged(agg: Aggregate, keys: list[str], schema: pa.Schema, finish: bool):
    """Task function over states sorted by key: one row per key, a state or the result."""

    def row_of(key, state):
        if not finish:
            return (*key, state)
        result = agg.finish(state)
        return (*key, *[result[f.name] for f in list(schema)[len(key):]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, s in zip(_keys(batch, keys), batch.column(STATE).to_pylist()):
                if state is not None and k == key:
                    state = agg.merge(state, s)
                    continue
                if state is not None:
                    out.append(row_of(key, state))
                key, state = k, s
                if len(out) >= OUT_ROWS:
                    yield _rows(out, schema)
                    out = []
        if state is not None:
            out.append(row_of(key, state))
        if out:
            yield _rows(out, schema)

    return work


def aggregate_groups(df: DataFrame, keys, columns, agg: Aggregate, open_groups: int = OPEN_GROUPS) -> DataFrame:
    """One row per group: its keys and the fields of ``agg.result``. Null is a key like any other.

    States are made before the shuffle, for at most about ``open_groups`` groups of a task at a time,
    merged in up to SALTS parts of a group, then once more.
    """
    keys, columns = list(keys), list(columns)
    state = T.StructField(STATE, T.StructType.fromDDL(agg.state))
    mid = T.StructType([*_fields(df, keys), state])
    out = T.StructType([*_fields(df, keys), *T.StructType.fromDDL(agg.result)])
    parts = df.select(*keys, *[c for c in columns if c not in keys])
    states = parts.mapInArrow(_partial(agg, keys, columns, to_arrow_schema(mid), open_groups), mid)
    salted = states.withColumn("_salt", F.spark_partition_id() % SALTS)
    salted = salted.repartition(*keys, "_salt").sortWithinPartitions("_salt", *keys)
    fewer = salted.mapInArrow(_merged(agg, keys, to_arrow_schema(mid), False), mid)
    sorted_ = fewer.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(_merged(agg, keys, to_arrow_schema(out), True), out)


# passes over ordered rows --------------------------------------------------------------------


def _summaries(scan: Scan, columns: list[str], schema: pa.Schema):
    """Task function over rows sorted by range: the state of each range's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            values = batch.select(columns).to_pandas()
            for key, first, end in _runs(_keys(batch, [RANGE])):
                found = scan.summary(values.iloc[first:end])
                if state is not None and key != at:
                    yield _rows([(*at, state)], schema)
                    state = None
                at, state = key, found if state is None else scan.merge(state, found)
        if state is not None:
            yield _rows([(*at, state)], schema)

    return work


def _applied(scan: Scan, keys: list[str], columns: list[str], before: dict[int, dict], schema: pa.Schema):
    """Task function over rows sorted by range, key and order: the rows with their new columns."""
    added = list(schema)[-len(T.StructType.fromDDL(scan.result)):]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            values = batch.select(columns).to_pandas()
            parts: list[list[pa.Array]] = [[] for _ in added]
            for key, first, end in _runs(_keys(batch, [RANGE, *keys])):
                if at is None or key != at:
                    # Only the first group of a range can have begun in an earlier one.
                    state = before.get(key[0]) if at is None or at[0] != key[0] else None
                    at = key
                rows = values.iloc[first:end]
                found = scan.apply(state, rows)
                for part, field in zip(parts, added):
                    part.append(pa.array(found[field.name], field.type, from_pandas=True))
                later = scan.summary(rows)
                state = later if state is None else scan.merge(state, later)
            new = [pa.concat_arrays(p) if p else pa.array([], f.type) for p, f in zip(parts, added)]
            old = [batch.column(f.name).cast(f.type) for f in list(schema)[: -len(added)]]
            yield pa.RecordBatch.from_arrays([*old, *new], schema=schema)

    return work


def scan_groups(df: DataFrame, keys, order, columns, scan: Scan, parts: int | None = None) -> DataFrame:
    """``df`` with the fields of ``scan.result``, worked out along ``order`` in each group.

    Rows are cut into ranges of (keys, order); ``order`` should be total within a group. A group that
    spans ranges is summed up range by range first, so each range starts from the state of the rows
    before it. Only the first key and one state of each range reach the driver. New columns
    replace those of the same name.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    added = T.StructType.fromDDL(scan.result)
    kept = df.drop(*added.names)
    ranged = range_ids(df, [F.col(c) for c in [*keys, *order]], parts)
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*keys)
    ends = ranged.groupBy(RANGE).agg(F.min(group).alias("_first"), F.max(group).alias("_last")).orderBy(RANGE).collect()
    open_ = [(a, b) for a, b in zip(ends, ends[1:]) if a["_last"] == b["_first"]]
    before: dict[int, dict] = {}
    if open_:
        bounds = df.sparkSession.createDataFrame(
            [(a[RANGE], *a["_last"]) for a, _ in open_],
            T.StructType([T.StructField(RANGE, T.IntegerType()), *_fields(df, keys)]),
        )
        some = ranged.select(RANGE, *dict.fromkeys([*keys, *order, *columns]))
        small = F.broadcast(bounds)  # one row per range
        rows = some.join(small, null_safe_equal(some, small, [RANGE, *keys]), "left_semi")
        rows = rows.repartition(count, RANGE).sortWithinPartitions(RANGE, *order)
        mid = T.StructType([T.StructField(RANGE, T.IntegerType()), T.StructField(STATE, T.StructType.fromDDL(scan.state))])
        found = rows.mapInArrow(_summaries(scan, columns, to_arrow_schema(mid)), mid).collect()
        own = {r[RANGE]: r[STATE].asDict(recursive=True) for r in found}
        for a, b in open_:
            earlier = before.get(a[RANGE]) if a["_first"] == a["_last"] else None
            state = own[a[RANGE]]
            before[b[RANGE]] = state if earlier is None else scan.merge(earlier, state)
    out = T.StructType([*kept.schema, *added])
    rows = ranged.repartition(count, RANGE).sortWithinPartitions(RANGE, *keys, *order)
    return rows.mapInArrow(_applied(scan, keys, columns, before, to_arrow_schema(out)), out)


# callables of the features -------------------------------------------------------------------


def rolling(value: str, rows: int, prefix: str) -> Scan:
    """Mean, sample std, min and max of the last ``rows`` known or unknown values, from the first row on."""
    names = [f"{prefix}_{n}" for n in ("mean", "std", "min", "max")]

    def tail(values) -> dict:
        last = np.asarray(values, float)[-(rows - 1):] if rows > 1 else []
        return {"tail": [None if np.isnan(v) else float(v) for v in last]}

    def joined(earlier, values) -> pd.Series:
        past = [np.nan if v is None else v for v in (earlier or {"tail": []})["tail"]]
        return pd.Series(np.concatenate([np.array(past, float), np.asarray(values, float)]))

    def apply(before, frame) -> dict:
        values = joined(before, frame[value])
        window = values.rolling(rows, min_periods=1)
        found = (window.mean(), window.std(), window.min(), window.max())
        return {n: s.to_numpy()[-len(frame):] for n, s in zip(names, found)}

    return Scan(
        "tail array<double>", ", ".join(f"`{n}` double" for n in names),
        lambda frame: tail(frame[value]), lambda a, b: tail(joined(a, joined(b, []))), apply,
    )


def since_event(value: str, since: str, streak: str) -> Scan:
    """Rows since the last 1 in ``value`` (rows so far if there was none) and length of the run of ones."""

    def last(flags) -> int:
        found = np.flatnonzero(flags)
        return int(found[-1]) + 1 if len(found) else 0

    def summary(frame) -> dict:
        on = (frame[value] == 1).to_numpy()
        return {"rows": len(on), "event": last(on), "plain": last(~on)}

    def merge(a, b) -> dict:
        return {"rows": a["rows"] + b["rows"]} | {n: a["rows"] + b[n] if b[n] else a[n] for n in ("event", "plain")}

    def apply(before, frame) -> dict:
        start = before or {"rows": 0, "event": 0, "plain": 0}
        on = (frame[value] == 1).to_numpy()
        at = start["rows"] + np.arange(1, len(on) + 1)
        event, plain = (np.maximum.accumulate(np.where(f, at, start[n])) for f, n in ((on, "event"), (~on, "plain")))
        return {since: at - event, streak: at - plain}

    return Scan("rows long, event long, plain long", f"`{since}` long, `{streak}` long", summary, merge, apply)


def joined_values(texts: dict[str, str], flags: dict[str, str]) -> Aggregate:
    """Distinct texts in order, joined by semicolons, and whether a flag is ever set (1 or 0); names by column."""
    names = {**texts, **flags}

    def update(frame) -> dict:
        return {c: sorted(set(frame[c].dropna())) for c in texts} | {c: bool((frame[c] == True).any()) for c in flags}  # noqa: E712

    def merge(a, b) -> dict:
        return {c: sorted({*a[c], *b[c]}) for c in texts} | {c: a[c] or b[c] for c in flags}

    def finish(state) -> dict:
        return {names[c]: ";".join(state[c]) for c in texts} | {names[c]: int(state[c]) for c in flags}

    state = [f"`{c}` array<string>" for c in texts] + [f"`{c}` boolean" for c in flags]
    result = [f"`{n}` string" for n in texts.values()] + [f"`{n}` long" for n in flags.values()]
    return Aggregate(", ".join(state), ", ".join(result), update, merge, finish)
