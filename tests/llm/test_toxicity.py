"""The classifier chain on held-out rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rulewright.llm import toxicity as X

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    got = X.score(docs, X.train(docs, labels.where(~held), X.label_categories())).join(labels.where(held), "doc_id").collect()
    right = [(r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in got]
    assert sum(right) >= 0.9 * len(right)
    clean = [r["p_toxic"] < 0.5 for r in got if not r["toxic"]]
    assert sum(clean) >= 0.98 * len(clean)


def test_chain_learns_and_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["calm", "fine", "blue", "tree"]) for _ in range(20)) + (" you moron" if i % 3 == 0 else " sch*" if i % 7 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "moron"), (902, "MORON!"), (902, "MORON!")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(5000, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = X.score(docs, X.train(docs, labels, X.label_categories())).collect()
    assert len(got) == 405
    for g in got:
        bad = g["doc_id"] is None or g["doc_id"] == 902 or (g["doc_id"] < 900 and g["doc_id"] % 3 == 0)
        assert (g["p_toxic"] >= 0.5) == bad, g


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = X.train(docs, labels, X.label_categories())
    assert X.score(docs, chain).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert X.score(one, chain).first()["p_toxic"] < 0.5


def test_chain_is_the_plain_one():
    """Weights of a plain chain: each category's model gets the earlier ones' out-of-fold probabilities."""
    import numpy as np

    r = np.random.default_rng(2)
    x = (r.random((600, 12)) < 0.3).astype(np.float32)
    a = (x[:, 0] + x[:, 1] + 0.3 * r.random(600) > 1).astype(np.float32)
    b = ((a == 1) & (x[:, 2] == 1)).astype(np.float32)
    y = np.stack([a, b], 1)
    chain = X.fit_chain(x, y, ("a", "b"), np.arange(12, dtype=np.uint64), folds=3)

    def plain(x, y, l2=1e-3):  # Newton's method
        z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
        w, ridge = np.zeros(z.shape[1]), l2 * np.diag([1.0] * x.shape[1] + [0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge, z.T @ (p - y) / len(z) + ridge @ w)
        return w

    held, first = np.zeros(600), plain(x, a)
    for i in range(3):
        out = np.arange(600) % 3 == i
        w = plain(x[~out], a[~out])
        held[out] = 1 / (1 + np.exp(-(x[out] @ w[:-1] + w[-1])))
    second = plain(np.hstack([x, held[:, None]]), b)
    p1 = 1 / (1 + np.exp(-(x @ first[:-1] + first[-1])))
    p2 = 1 / (1 + np.exp(-(np.hstack([x, p1[:, None]]) @ second[:-1] + second[-1])))
    got = chain.predict(x)
    assert np.abs(got[:, 0] - p1).max() < 0.05 and np.abs(got[:, 1] - p2).max() < 0.05
