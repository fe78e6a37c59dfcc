import hashlib
import random

import numpy as np
import pytest

from shelfcast.llm import minhash
from shelfcast.llm.queries import op5_minhash_fingerprints
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def runs(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def check(rows, found):
    """rows: (id, text) with distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in found}
    assert len(got) == len(found) == len(rows)
    off = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 512
        off.append(abs(r["near_edited"] - jaccard(runs(text), runs(edited))))
        off.append(abs(r["near_next"] - jaccard(runs(text), runs(after))))
        if text == after:
            assert r["near_next"] == 1 and r["fingerprint"] == got[order[(k + 1) % len(order)][0]]["fingerprint"]
    assert np.mean(off) < 0.03 and max(off) < 0.25


def test_query_estimates_jaccard(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check(rows, op5_minhash_fingerprints(spark, FOLDER).collect())


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_odd_rows_and_parts(make_docs, parts):
    rows = [(k * 3, t) for k, (_, t) in enumerate(ODD)] + [(None, "last one by itself")]
    check(rows, minhash.with_next(make_docs(rows).repartition(5), parts=parts).collect())


def test_repeated_and_missing_ids(odd_docs, no_docs, make_docs):
    assert minhash.with_next(odd_docs).count() == len(ODD)
    assert minhash.with_next(no_docs).count() == 0
    alone = minhash.with_next(make_docs([(1, "a b c d")])).first()
    assert alone["near_next"] == 1 and alone["near_edited"] < 1
    assert minhash.with_next(make_docs([(None, "a"), (None, "b")])).count() == 2


def brute_classes(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: runs(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(make_docs):
    """Chains in which only neighbours are near, copies, and texts that share a passage."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    passage = rnd.choices(words, k=60)
    rows, i = [], 0
    for _ in range(6):
        text = rnd.choices(words, k=150)
        for _ in range(8):
            rows.append((i, " ".join(text)))
            at = rnd.randrange(150)
            text = [*text[:at], rnd.choice(words), *text[at + 1 :]]
            i += 1
    for _ in range(20):
        rows.append((i, " ".join(passage + rnd.choices(words, k=100))))
        i += 1
    rows += [(i, rows[3][1]), (i + 1, ""), (i + 2, None)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows)
