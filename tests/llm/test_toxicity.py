import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import toxicity
from shelfcast.llm.queries import op6_toxicity
from tests.llm.conftest import ODD


def auc(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    pos = truth.sum()
    return (order[truth == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = op6_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    rows = rows[rows.held_out]
    truth = rows.toxic.to_numpy()
    assert auc(rows.score.to_numpy(), truth) > 0.95
    assert rows.predicted[truth == 1].mean() > 0.85
    assert rows.predicted[truth == 0].mean() < 0.02


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toy(make_docs, spark):
    rows = [(i, f"common words here {('grubbish', 'lovely', 'lovely', 'lovely', 'grubbo', 'lovely', 'lovely', 'lovely')[i % 8]} number w{i}") for i in range(400)]
    return make_docs([*rows, *[(1000 + k, t) for k, (_, t) in enumerate(ODD)]]), labels(
        spark, [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None), (None, 1, 1), (5, 0, 0)]
    )


def test_learns_unknown_words_and_their_beginnings(spark, make_docs):
    docs, marks = toy(make_docs, spark)
    fresh = make_docs([(5000, "see the grubbly thing"), (5001, "see the lovely thing"), (5002, None)])
    scorer = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(fresh, scorer).collect()}
    assert got[5000] > 0.5 > got[5001] and got[5002] < 0.5


def test_one_row_each_and_clean_rows_stay(spark, make_docs):
    docs, marks = toy(make_docs, spark)
    docs = docs.withColumn("score", F.lit("x"))
    found = toxicity.score(docs, marks).collect()
    assert len(found) == 400 + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(400) if i % 4}
    assert not {r["doc_id"] for r in kept.collect()} & {i for i in range(400) if i % 4 == 0}


def test_held_out_labels_are_not_used(spark, make_docs):
    docs, marks = toy(make_docs, spark)
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score(docs, m).select("doc_id", "score").collect()), key=str) for m in (marks, flipped))
    assert one == two


def test_correlated_voters_count_as_one():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    one = np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.1)
    other = np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.1)
    votes = np.stack([one, one, one, other], axis=1)
    model, _ = toxicity.fit_label_model(votes, np.where(truth, 0.9, 0.1))
    assert np.allclose(model.weight[:3], 1 / 3, atol=0.02) and model.weight[3] > 0.8
    assert abs(model.toxic[3] - 0.7) < 0.08 and abs(model.clean[3] - 0.1) < 0.05


def test_without_labels_or_rows(spark, odd_docs, no_docs):
    none = labels(spark, [])
    assert toxicity.score(odd_docs, none).count() == len(ODD)
    assert toxicity.keep_clean(odd_docs, none).count() == len(ODD)
    assert toxicity.score(no_docs, none).count() == 0


def test_repeated_ids_give_one_training_row(spark, make_docs):
    docs = make_docs([*[(1, f"copy {i % 3}") for i in range(50)], (1, None), (2, "other"), (3, None)])
    marks = labels(spark, [(1, 1, 1), (2, 1, 0), (3, 1, 0)])
    ids = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    found = toxicity.training_rows(docs, marks).collect()
    assert len(found) == len(ids)
    assert 1 in ids and [r["text"] in {"copy 0", "copy 1", "copy 2"} for r in found if r["toxic"] == 1] == [True]
