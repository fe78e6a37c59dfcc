import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import mixing
from shelfcast.llm.queries import op3_mixing
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes):
    """Share out by weight, cut at twice the size, share the excess again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, spare = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    for _ in range(1000):
        open_ = [s for s in names if out[s] < 2 * sizes[s]]
        if spare < 1e-9 or not open_:
            break
        share = spare / sum(weight[s] for s in open_)
        spare = 0.0
        for s in open_:
            out[s] += share * weight[s]
            spare += max(0.0, out[s] - 2 * sizes[s])
            out[s] = min(out[s], 2 * sizes[s])
    return out


def check(rows, found, near):
    """rows: (id, text, source)."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, source = brute_targets(sizes), {i: s for i, _, s in rows}
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=str) == sorted(((i, size(t)) for i, t, _ in rows), key=str)
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s)


def test_query_meets_its_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs]
    most = defaultdict(int)
    for _, t, s in rows:
        most[s] = max(most[s], size(t))
    found = op3_mixing(spark, FOLDER).collect()
    check(rows, found, lambda s: most[s] / 2 + 1)
    assert sorted(found) == sorted(op3_mixing(spark, FOLDER).collect())


def test_odd_rows(make_docs, spark):
    rows = [(i, t, (None, "b", "é", "a")[k % 4]) for k, (i, t) in enumerate(ODD)]
    docs = make_docs(rows).withColumn("size", F.lit("x")).withColumn("mix_key", F.lit(1))
    found = mixing.mix(docs, F.array("source"), mixing.word_count()).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"]


def test_many_documents_come_close(make_docs):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(1, 300), f"s{i % 7}") for i in range(4000)]
    found = mixing.mix(make_docs(rows), F.array("source"), mixing.word_count()).collect()
    check(rows, found, lambda s: 5)


def test_mixed_documents_repeat_rows(make_docs):
    rows = [(i, "a b c", f"s{i % 3}") for i in range(30)]
    docs = make_docs(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += 3
    assert words == {"s0": 60, "s1": 24, "s2": 51} or all(
        abs(words[s] - t) <= 2 for s, t in brute_targets({"s0": 30, "s1": 30, "s2": 30}).items()
    )


def brute_route(capacity, members, quota, passes):
    """Word by word: try slots of cheaper passes first, with augmenting paths."""
    slots = [(k, p) for k in range(passes) for p, c in enumerate(capacity) for _ in range(c)]
    places = [s for s, n in quota.items() for _ in range(n)]
    held = {}

    def give(i, seen):
        for j, s in enumerate(places):
            if s in members[slots[i][1]] and j not in seen:
                seen.add(j)
                if j not in held or give(held[j], seen):
                    held[j] = i
                    return True
        return False

    return sorted(slots[i][0] for i in range(len(slots)) if give(i, set()))


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_the_cheapest(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", None]
    members = [tuple(rnd.sample(names, rnd.randint(1, 3))) for _ in range(5)]
    capacity = [rnd.randint(0, 5) for _ in members]
    quota = {s: rnd.randint(0, 9) for s in names}
    flow = mixing.route(capacity, members, quota, 3)
    costs = []
    for c, f in zip(capacity, flow):
        total = sum(f.values())
        assert min(f.values()) >= 0 and total <= 3 * c
        costs += [k for k in range(3) for _ in range(min(c, max(0, total - k * c)))]
    for s in names:
        assert sum(f.get(s, 0) for f in flow) <= quota[s]
    assert sorted(costs) == brute_route(capacity, members, quota, 3)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs, F.array("source"), mixing.word_count()).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_clashing_names(make_docs):
    """A column called like an added one, in another case, gives way to it."""
    docs = make_docs([(1, "a b c", "s"), (2, "d", "t")]).withColumn("SIZE", F.lit("x")).withColumn("a.b", F.lit(1))
    out = mixing.mix(docs, F.array("source"), mixing.word_count())
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "size", "source_size", "target", "taken"]
    assert {(r["doc_id"], r["size"]) for r in out.collect()} == {(1, 3), (2, 1)}
