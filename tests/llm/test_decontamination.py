import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import decontamination
from shelfcast.llm.queries import op11_decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(rows, items, length=10):
    """(id, n_words, hit word numbers, items) of each row."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        if words:
            for k in range(max(len(words) - length, 0) + 1):
                windows[tuple(words[k : k + length])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if got := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((doc, len(words), sorted(hit), sorted(found)))
    return out


def got(df):
    out = []
    for r in df.collect():
        hit = [w for s in r["spans"] for w in range(s["first_word"], s["first_word"] + s["words"])]
        assert len(hit) == r["n_hit"]
        out.append((r["doc_id"], r["n_words"], hit, r["items"]))
    return sorted(out, key=str)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Lonely"), (3, "TWO, three? four!"), (4, ""), (5, None),
    (None, "ÄÖ ü"), (3, "six seven eight"), (10, "one two three four five six seven eight nine ten"), (6, "...")]
TEXTS = [
    (1, "say One two-three four five six seven eight nine ten eleven twelve, and one two three"), (2, "lonely lonely LONELY. xlonely"),
    (3, "two three\nfour two three four six seven eight"), (4, None), (5, ""), (6, "ÄÖ ü äö Ü"), (7, "two three"), (8, "four lonely"),
    (8, "four lonely"), (None, "lonely"), (9, "pad " * 40_000 + "lonely" + " Ⅷ pad" * 40_000)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("at_once", [100_000, 3])
def test_brute_force(spark, make_docs, items, at_once):
    found = decontamination.scan(make_docs(TEXTS), items, windows_at_once=at_once, keep=["doc_id"])
    assert got(found) == sorted(brute(TEXTS, ITEMS), key=str)


def test_odd_rows(odd_docs, items):
    from tests.llm.conftest import ODD

    assert got(decontamination.scan(odd_docs, items)) == sorted(brute(ODD, ITEMS), key=str)


def test_query_finds_each_passage(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = {d: (n, len(h), len(i)) for d, n, h, i in brute(rows, items)}
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in op11_decontamination(spark, FOLDER).collect()}
    assert found == expected and any(h for _, h, _ in expected.values())


def test_spans_are_places_in_the_original(make_docs, items):
    text = "Ⅷ say “Lonely”, two THREE four ü"
    spans = decontamination.scan(make_docs([(1, text)]), items).first()["spans"]
    # The quotation marks are letters of their word, so that one is no match.
    assert [text[s["start"] : s["stop"]] for s in spans] == ["two THREE four"]


def test_a_third_of_all_rows_hold_the_hottest_window(spark, make_docs):
    rows = [(i, "lonely " * 50 if i % 3 == 0 else f"w{i} x") for i in range(3000)]
    items = spark.createDataFrame([(k, "lonely") for k in range(50)], "item_id long, text string")
    found = decontamination.scan(make_docs(rows).repartition(8), items, keep=["doc_id"])
    total = found.agg(F.sum("n_hit"), F.sum(F.size("items"))).first()
    assert tuple(total) == (50_000, 50_000)


def test_drop_and_cut(make_docs, items):
    docs = make_docs([(1, "a lonely b"), (2, "clean"), (3, None), (4, "lonely")])
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontamination.cut_passages(docs, items).collect()}
    assert cut == {1: "a  b", 2: "clean", 3: None, 4: ""}


def test_empty_sides(spark, make_docs, no_docs, items):
    none = items.limit(0)
    assert decontamination.scan(no_docs, items).count() == 0
    row = decontamination.scan(make_docs([(1, "a b")]), none).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


def test_clashing_and_dotted_columns(make_docs, items):
    docs = make_docs([(1, "lonely")]).withColumn("Items", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("c0", F.lit(2))
    found = decontamination.scan(docs, items)
    assert found.columns == [*docs.columns, "n_words", "n_hit", "spans", "items_"]
    assert found.first()["Items"] == "x" and found.first()["items_"] == ["2"]
    assert decontamination.cut_passages(docs, items).columns == docs.columns
    assert decontamination.drop_contaminated(docs, items).columns == docs.columns
