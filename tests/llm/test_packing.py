import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import packing
from shelfcast.llm.queries import op9_best_fit_packing, tokenizer

PATH = tokenizer("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def brute_pieces(rows, capacity=4096):
    whole = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[s : s + capacity], "<u4")
            out.append((doc, k, s, len(cut), zlib.crc32(cut.tobytes())))
    return out


def check(found, rows, capacity=4096, slack=1.02):
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(brute_pieces(rows, capacity), key=str)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    assert len(bins) <= math.ceil(total / capacity * slack) + 1


def test_query_round_trip(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check(op9_best_fit_packing(spark, FOLDER).collect(), rows)


def test_odd_rows(odd_docs):
    from tests.llm.conftest import ODD

    check(packing.pack(odd_docs, PATH).collect(), ODD)


@pytest.mark.parametrize("per_task", [2, 50_000])
def test_merging_rounds(make_docs, per_task):
    rows = [(i, "w " * (1 + i * 7 % 23)) for i in range(200)]
    docs = make_docs(rows).repartition(7)
    found = packing.pack(docs, PATH, capacity=32, per_task=per_task).collect()
    check(found, rows, 32, 1.3 if per_task == 2 else 1.1)


def test_items_that_never_merge(make_docs):
    rows = [(i, "w " * 20) for i in range(50)]
    found = packing.pack(make_docs(rows).repartition(5), PATH, capacity=32, per_task=3).collect()
    assert len({r["sequence_id"] for r in found}) == 50


def test_best_fit_takes_the_tightest_bin():
    place, offset, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill.tolist() == [10, 10] and place[0] == place[2] and offset.tolist() == [0, 0, 6, 5, 8]


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
