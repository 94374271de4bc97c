"""Held-out accuracy, the label model's recovery of known accuracies, and edge cases."""

import zlib

import numpy as np

from stackroom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [(r.predicted, truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(p == y == 1 for p, y, _ in tested)
    print(len(tested), hits, sum(p for p, _, _ in tested), sum(y for _, y, _ in tested))
    assert hits / sum(p for p, _, _ in tested) >= 0.95
    assert hits / sum(y for _, y, _ in tested) >= 0.8


def test_label_model_recovers_posteriors():
    rng = np.random.default_rng(5)
    y = rng.random(40_000) < 0.2
    hit, miss = np.array([0.8, 0.6, 0.7, 0.5, 0.4, 0.6]), np.array([0.05, 0.1, 0.02, 0.05, 0.1, 0.03])
    v = rng.random((len(y), 6)) < np.where(y[:, None], hit, miss)
    v[:, 5] = np.where(rng.random(len(y)) < 0.8, v[:, 4], v[:, 5])  # two correlated voters
    code = v @ (1 << np.arange(6))
    known = rng.random(len(y)) < 0.05
    votes = np.unique(code)
    n = np.array([(code == c).sum() for c in votes], float)
    n_known = np.array([[((code == c) & known & (y == k)).sum() for k in (0, 1)] for c in votes], float)
    post = toxicity.label_model(votes, n, n_known, 6)
    true = np.array([y[code == c].mean() for c in votes])
    assert (n * np.abs(post - true)).sum() / n.sum() < 0.02


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "y y"), (4, "y y")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS votes")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    many = spark.createDataFrame([(i, "bad rotten" if i % 3 == 0 else f"fine w{i % 7}") for i in range(600)] + [(None, "bad"), (1000, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(many, labels).collect()
    assert len(rows) == 603
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 600)
    assert all(0 <= r.score < 0.5 for r in rows if r.doc_id == 1000)
    assert toxicity.score_documents(many.limit(0), labels).count() == 0
