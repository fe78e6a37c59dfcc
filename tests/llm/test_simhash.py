import random
import re

import numpy as np
import pytest
import xxhash

from shelfcast.llm import simhash
from shelfcast.llm.components import components
from shelfcast.llm.queries import op7_simhash_near_dedup
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint); links by comparing all."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def check(rows, found):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints))), key=str)
    assert sorted(found, key=str) == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, [tuple(r) for r in op7_simhash_near_dedup(spark, FOLDER).collect()])


def test_odd_rows(odd_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    check(ODD, [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found])


def clusters(seed, centres, each, flips):
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cell, blocks", [(7, 6), (1000, 6), (1000, 7), (20, 8)])
def test_links_lose_nothing(spark, cell, blocks):
    """Chains, stars and random patterns; a small cell cuts the buckets into blocks."""
    fps = clusters(cell, 12, 25, 5) + [0, (1 << 64) - 1, 15, 31]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    out = components(simhash.links(rows, blocks=blocks, per_cell=cell))
    root = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in out.collect()}
    classes = {}
    for f in fps:
        classes.setdefault(root.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(fps, brute_components(list(zip(fps, fps)))):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_tree_finds_all_pairs():
    fps = np.array(clusters(3, 5, 60, 4), dtype=np.uint64)
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    group = np.sort(np.arange(len(fps)) % 3)
    got = {(i, j) for a, b in simhash.close_pairs(fps, group, 4) for i, j in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(apart)) if i < j and group[i] == group[j]}
    assert got == want


def test_one_document_of_each_group_stays(make_docs):
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["other"] + base[201:]
    docs = make_docs([(3, " ".join(base)), (1, " ".join(near)), (2, "quite another text of a few words"), (7, None), (8, "")])
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 7]


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 4, 7])
def test_buckets_stay_small_as_the_table_grows(bits):
    """Random fingerprints a bucket: the table shared out over the patterns of the shortest key."""
    taken = []
    for power in range(3, 14):
        n = 10**power
        blocks = simhash.blocks_for(n, bits)
        widths = sorted(b - a for a, b in zip(simhash.block_edges(blocks), simhash.block_edges(blocks)[1:]))
        assert sum(widths) == 64 and blocks > bits
        assert n / 2 ** sum(widths[: blocks - bits]) <= simhash.ROWS_PER_BUCKET
        taken.append(blocks)
    assert taken == sorted(taken)
    assert simhash.blocks_for(10**6) == simhash.BLOCKS
