import random

import numpy as np
import pyarrow as pa

from shelfcast.llm import license_scan as ls
from shelfcast.llm.queries import op10_license_scan
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.01"


def brute(text, templates=ls.TEMPLATES):
    """Best containment of each template over all stretches of twice its length."""
    words = ls.plain_words(text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, template in templates.items():
        want = ls.runs_of(ls.plain_words(template))
        hits = [i for i, r in enumerate(runs) if r in want]
        n = len(want)
        best = max((len({runs[i] for i in hits if a <= i < a + 2 * n}) for a in hits), default=0)
        if best / n >= 0.8:
            out[name] = best / n
    return out


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op10_license_scan(spark, FOLDER).collect()
    assert len(found) == len(docs)
    some = 0
    for r in found:
        want = brute(docs[r["doc_id"]])
        assert r["licenses"] == ",".join(sorted(want)) and r["n_licenses"] == len(want)
        some += bool(want)
    assert some > 10


def test_every_template_is_found_inside_other_text():
    """Edited, recased and cut notices at random places of long texts."""
    rnd = random.Random(1)
    filler = [f"word{i}" for i in range(3000)]
    texts, want = [], []
    for name, template in ls.TEMPLATES.items():
        for _ in range(6):
            words = template.split()
            spare = int(0.2 * max(0, len(words) - 4))
            cut = words[rnd.randint(0, spare) :] if spare else words
            before = rnd.choices(filler, k=rnd.randint(0, 900))
            after = rnd.choices(filler, k=rnd.randint(0, 900))
            texts.append(" ".join([*before, *(w.upper() for w in cut), *after]))
            want.append(name)
    found = ls.scan_texts(pa.array(texts), ls.Catalog(ls.TEMPLATES))
    for text, name, notices in zip(texts, want, found):
        assert {n[0]: n[1] for n in notices}.keys() == brute(text).keys()
        if name in brute(text):
            assert name in {n[0] for n in notices}


def test_places_and_text_borders():
    texts = ["a b Released under the", "MIT License. c", "x y Released under the MIT License. z"]
    found = ls.scan_texts(pa.array(texts), ls.Catalog(ls.TEMPLATES))
    assert found == [[], [], [("MIT", 1.0, 2, 7)]]


def test_longest_class_and_repeats():
    many = {f"t{i}": " ".join(f"v{i}x{k}" for k in range(4 + 3 * i)) for i in range(1, 40)}
    texts = [" ".join(["u"] * i + [t] + ["u"] * 9 + [t]) for i, t in enumerate(many.values())]
    found = ls.scan_texts(pa.array(texts), ls.Catalog(many))
    assert [[n[0] for n in f] for f in found] == [[f"t{i}"] for i in range(1, 40)]


def test_odd_rows(odd_docs, no_docs):
    assert ls.scan(odd_docs).count() == len(ODD)
    assert not any(r["notices"] for r in ls.scan(odd_docs).collect())
    assert ls.scan(no_docs).count() == 0


def test_run_hashes_are_those_of_the_runs():
    h = np.arange(1, 12, dtype=np.uint64)
    all_, tail = ls.run_hashes(h), ls.run_hashes(h[3:])
    assert (all_[3:] == tail).all() and len(all_) == 7


def test_full_texts_are_found_whole_and_cut():
    full, rnd = ls.full_texts(), random.Random(2)
    assert len(full) >= 16
    filler = [f"word{i}" for i in range(300)]
    texts = []
    for text in full.values():
        words = text.split()
        part = words[len(words) // 12 : len(words) - len(words) // 12]
        texts += [" ".join([*rnd.choices(filler, k=50), *w, *rnd.choices(filler, k=70)]) for w in (words, part)]
    found = ls.scan_texts(pa.array(texts), ls.Catalog(ls.TEMPLATES | full | ls.SHORT_TEMPLATES))
    for name, whole, cut in zip(full, found[::2], found[1::2]):
        assert {n[0]: n[1] for n in whole}[name] == 1.0
        assert {n[0]: n[1] for n in cut}[name] >= 0.8


def test_notices_of_under_five_words():
    texts = ["a b (c) 2020 X. All rights reserved.", "all rights", "reserved", "all Rights, reserved all rights reserved", ""]
    want = [("all-rights-reserved", 1.0, 5, 8)], [], [], [("all-rights-reserved", 1.0, 0, 3)], []
    assert ls.scan_texts(pa.array(texts), ls.Catalog(ls.SHORT_TEMPLATES)) == list(want)
    found = ls.scan_texts(pa.array(["// SPDX-License-Identifier: MIT"]), ls.Catalog(ls.TEMPLATES | ls.SHORT_TEMPLATES))
    assert [[n[0] for n in f] for f in found] == [["SPDX-MIT"]]


def test_query_lists_short_notices(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r["doc_id"]: r["short_notices"] for r in op10_license_scan(spark, FOLDER).collect()}
    with_it = {i for i, t in docs.items() if "all rights reserved" in " ".join(ls.plain_words(t or ""))}
    assert with_it and {i for i, n in found.items() if "all-rights-reserved" in n} == with_it
