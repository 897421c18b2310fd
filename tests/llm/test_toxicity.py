from __future__ import annotations

import random

import edges
import numpy as np

from keyvigil.llm import toxicity


def test_held_out_documents(spark):
    """Trained on four fifths of the labelled documents, tested on the rest."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.trained(toxicity.identified(docs), labels.where("doc_id % 5 <> 0"))
    held = docs.join(labels.where("doc_id % 5 = 0").select("doc_id", "toxic"), "doc_id")
    found = toxicity.scored(toxicity.identified(held), model).join(labels, toxicity.F.col("_doc_id") == toxicity.F.col("doc_id")).collect()
    truth = np.array([r["toxic"] for r in found]) == 1
    said = np.array([r["p_toxic"] for r in found]) >= 0.5
    assert truth.sum() > 20
    assert (said & truth).sum() >= 0.95 * truth.sum()
    assert (said & ~truth).sum() <= 0.01 * (~truth).sum()
    severity = np.array([r["severity"] for r in found])
    assert severity[truth].mean() > severity[~truth].mean() + 0.5


def test_grades_are_ordered_by_shared_weights():
    """Grades drawn from the model itself come back: weights, order of thresholds, expected grade."""
    rng = np.random.default_rng(3)
    n, weights, thresholds = 6000, np.array([2.0, -1.0, 0.5]), np.array([-0.5, 1.0, 2.5])
    x = rng.random((n, 3)) * 2
    below = 1 / (1 + np.exp((x @ weights)[:, None] - thresholds[None, :]))
    grade = (rng.random(n)[:, None] > below).sum(axis=1)
    row, column = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    model = toxicity.fit(row, column, x.ravel(), grade, np.arange(3, dtype=np.uint64), 3)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.abs(model.weights - weights).max() < 0.25 and np.abs(model.thresholds - thresholds).max() < 0.3
    assert abs(model.above(x @ model.weights).sum(axis=1).mean() - grade.mean()) < 0.05


def test_odd_cases(spark):
    rng = random.Random(4)
    rows = [(i, edges.sentence(rng, 30) + (" vile rotten" if i % 3 == 0 else "")) for i in range(90)] + [(200, None), (201, ""), (None, "vile"), (None, "vile")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.severities(edges.frame(spark, rows), labels).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["toxic"] == (i % 3 == 0) for i in range(90))
    assert not by[200]["toxic"] and by[200]["severity"] == by[201]["severity"] < by[0]["severity"]
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["grade"] <= toxicity.GRADES for r in found)
    none = toxicity.severities(edges.frame(spark, rows), labels.where("toxic = 0")).collect()
    assert all(r["severity"] == 0 and not r["toxic"] for r in none)
    assert toxicity.severities(edges.frame(spark, [], 1), labels).count() == 0


def test_base_rate_does_not_follow_the_sample(spark):
    """A small sample has as many toxic as other texts, but the probabilities are those of all labels."""
    rng = random.Random(6)
    toxic = [i % 10 == 0 for i in range(2000)]
    # A word that most toxic texts hold, and a tenth of the others: neither label is certain.
    rows = [(i, edges.sentence(rng, 30) + (" vile" if rng.random() < (0.8 if bad else 0.1) else "")) for i, bad in enumerate(toxic)]
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, toxic int")
    docs = toxicity.identified(edges.frame(spark, rows)).cache()
    mean = {}
    for most in (2000, 150):
        found = toxicity.scored(docs, toxicity.trained(docs, labels, most)).collect()
        mean[most] = np.mean([r["p_toxic"] for r in found]), np.mean([r["severity"] for r in found])
    assert abs(mean[2000][0] - 0.1) < 0.02
    # The 150 other texts hold the word 15 times, give or take four.
    assert abs(mean[150][0] - 0.1) < 0.05 and abs(mean[150][1] - mean[2000][1]) < 0.1
