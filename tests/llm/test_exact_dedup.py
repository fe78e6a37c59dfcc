import hashlib

from pyspark.sql import functions as F

from shelfcast.llm import exact_dedup
from tests.llm.conftest import ODD


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(
        ((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
         for i, t in rows),
        key=str,
    )


def test_membership_equals_brute_force(odd_docs):
    for name, keep in (("largest", max), ("smallest", min)):
        got = sorted((tuple(r) for r in exact_dedup.membership(odd_docs, keep=name).collect()), key=str)
        assert got == brute(ODD, keep)


def test_colliding_hashes_are_told_apart(monkeypatch, make_docs):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.substring(F.col(c) if isinstance(c, str) else c, 1, 1))
    rows = [(1, "ab"), (2, "ac"), (3, "ab")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.membership(make_docs(rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_deduplicate_keeps_one_row_of_each_text(odd_docs):
    docs = odd_docs.withColumn("dedup_hash", F.lit("x")).withColumn("null_rank", F.lit(1))
    for keep, one in (("smallest", 4), ("largest", 5)):
        out = exact_dedup.deduplicate(docs, keep=keep)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted((r["text"] or "") for r in rows) == sorted({t or "" for _, t in ODD})
        assert [r["doc_id"] for r in rows if r["text"] == "one"] == [one]


def test_empty_table(no_docs):
    assert exact_dedup.membership(no_docs).count() == 0
    assert exact_dedup.deduplicate(no_docs).count() == 0
