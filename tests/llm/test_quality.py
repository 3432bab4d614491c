import numpy as np
from attest.llm.quality import BAD, GOOD, NONE, TRAINED, drawn, label_model, one_each, quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    votes = []
    for right, silent in ((0.95, 0.1), (0.8, 0.5), (0.9, 0.3), (0.99, 0.8)):
        vote = np.where(rng.random(len(good)) < right, good, ~good).astype(int)
        votes.append(np.where(rng.random(len(good)) < silent, NONE, vote))
    patterns, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    posterior, rates = label_model(patterns, counts.astype(float))
    for i, right in enumerate((0.95, 0.8, 0.9, 0.99)):
        said = rates[i, :, :2] / rates[i, :, :2].sum(axis=1, keepdims=True)
        assert abs(said[1, GOOD] - right) < 0.03 and abs(said[0, BAD] - right) < 0.03


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = {d for d in truth if d % 3 == 0}
    got = {r.doc_id: r.keep for r in quality(docs, labels.where("doc_id % 3 <> 0")).collect()}
    assert len(got) == docs.count()
    wrong = [d for d in held if got[d] != truth[d]]
    assert len(wrong) <= 0.04 * len(held), wrong
    assert sum(got[d] for d in held if truth[d]) >= 0.98 * sum(truth[d] for d in held)


def test_nulls_ties_long_and_empty(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "some words that are plain enough", 3), (4, "a b c d e f", 4), (4, "a b c d e f", 4),
            (4, "NOT THE SAME TEXT AT ALL!!", 5), (5, "plain words here " * 30_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, None, 1, "y"), (None, 0, 0, "z"), (5, 1, None, "")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality(docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 4, 4, 4, 5]
    assert quality(docs, labels.limit(0)).count() == 7
    assert quality(docs.limit(0), labels).count() == 0


def test_both_kinds_of_texts_train_the_scorer(spark):
    def kinds(annotated, others, trained):
        rows = [(i, i % (annotated + others), 0.5, i % (annotated + others) < annotated) for i in range(2 * (annotated + others))]
        got = [r.print for r in drawn(spark.createDataFrame(rows, "key long, print long, posterior double, known boolean"), trained).collect()]
        assert len(set(got)) == len(got)
        return sum(p < annotated for p in got), sum(p >= annotated for p in got)

    assert kinds(300, 300, 100) == (50, 50)
    assert kinds(300, 20, 100) == (80, 20)
    assert kinds(20, 300, 100) == (20, 80)
    assert kinds(30, 40, 100) == (30, 40)


def test_held_out_accuracy_beyond_the_bound(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert docs.select("text").distinct().count() > TRAINED
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = {d for d in truth if d % 3 == 0}
    good = {d for d in held if truth[d]}
    got = {r.doc_id: r.keep for r in quality(docs, labels.where("doc_id % 3 <> 0")).collect()}
    figures = sum(got[d] for d in good), len(good), sum(not got[d] for d in held - good), len(held - good)
    print("good kept, good, bad rejected, bad:", figures)
    assert figures[0] >= 0.98 * figures[1] and figures[2] >= 0.93 * figures[3], figures


def test_one_row_of_each_text_reaches_the_fit(spark):
    rows = [(i % 400, 1, "copy") for i in range(4_000)] + [(None, 2, "no key")] * 50 + [(7, 3, "same key")] * 50 + [(8, 4, "not drawn")]
    rows = spark.createDataFrame(rows, "key long, print long, text string").repartition(5)
    sample = spark.createDataFrame([(1, 0.5, 0), (2, 0.25, None), (3, 0.75, 7)], "print long, posterior double, key long")
    got = sorted((r.print, r.posterior, r.text) for r in one_each(rows, sample).collect())
    assert got == [(1, 0.5, "copy"), (2, 0.25, "no key"), (3, 0.75, "same key")]
