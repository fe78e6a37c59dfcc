from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm import test_mixing, test_packing, test_simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into and come out of each stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # An untouched text keeps its words; a copy, a null and an empty text join the table.
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(200_001, None, None, None, None), (200_002, "", "en", "src0", 0)], docs.schema)
    docs = docs.union(extra).union(odd)
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return [(a.collect(), b.collect(), a.columns, b.columns) for a, b in out]


def test_all_but_the_last_return_documents(stages):
    for _, _, before, after in stages[:-1]:
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in rows} for rows in stages[0][:2])
    gone = before - after
    assert after < before
    clean = [i for i in before if toxic.get(i) == 0]
    assert sum(i in gone for i in clean) <= 0.02 * len(clean) + 1


def test_one_document_of_each_text_stays(stages):
    before, after = stages[1][:2]
    best = {}
    for r in before:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_one_document_of_each_near_group_stays(stages):
    before, after = stages[2][:2]
    prints = [(r["doc_id"], test_simhash.brute_fingerprint(r["text"])) for r in before]
    assert sorted(r["doc_id"] for r in after) == sorted(set(test_simhash.brute_components(prints)))


def test_the_mix_meets_its_targets(stages):
    before, after = stages[3][:2]
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        n = test_mixing.size(r["text"])
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    for r in after:
        taken[r["source"]] += test_mixing.size(r["text"])
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    for s, t in test_mixing.brute_targets(sizes).items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1


def test_packed_pieces_are_the_documents(stages):
    before, after = stages[4][:2]
    test_packing.check(after, [(r["doc_id"], r["text"]) for r in before], slack=1.05)


def test_stages_keep_odd_columns(spark):
    """Dots, back-quotes and names that the stages use themselves come through every stage."""
    odd = {"a.b": F.col("doc_id") * 2, "c`d": F.lit("x"), "score": F.lit(7), "TAKEN": F.lit("y"), "copy": F.lit(None).cast("int")}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *[v.alias(k) for k, v in odd.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == (r["doc_id"] * 2, "x", 7, "y", None) for r in rows)


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
