"""PU learning: the risk against direct sums, odd rows, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import quality_classifier as qc
from spendlake.llm.queries import op10_quality_classifier

TEXTS = [None, "", " \n", "a", "plain words in a row", "LOUD!! WORDS!!", "x " * 50_000, "é\nü\né\n", "#*$%&|<>"]


def test_features():
    for t in TEXTS:
        x = qc.features(t)
        assert x.shape == (qc.N_FEATURES,) and np.isfinite(x).all()
    assert np.array_equal(qc.features(None), qc.features(""))


def test_risk_sums_equal_the_formula():
    rng = np.random.default_rng(0)
    x, p = rng.random((50, qc.N_FEATURES)), rng.random(50) < 0.4
    w, b = rng.standard_normal(qc.N_FEATURES), 0.3
    of, size = qc._risk_sums(np.zeros(qc.N_FEATURES), np.ones(qc.N_FEATURES), w, b)
    s = of(x, p)
    f = x @ w + b
    assert len(s) == size
    want = [50, p.sum(), np.log1p(np.exp(f)).sum(), np.log1p(np.exp(f[p])).sum(), np.log1p(np.exp(-f[p])).sum()]
    assert np.allclose(s[:5], want)


def test_odd_rows(spark):
    rows = [(i, t, "c", True) for i, t in enumerate(TEXTS)] + [(None, "no id", "c", True), (4, TEXTS[4], "c", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, learn boolean")
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model, feats = qc.train(docs, labels)
    got = qc.score(feats, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none, feats = qc.train(docs, labels.limit(0))
    assert {r.predicted for r in qc.score(feats, none).collect()} == {0}
    model, feats = qc.train(docs.limit(0), labels)
    assert qc.score(feats, model).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op10_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(rows) > 50 and right > 0.95
    assert np.mean([r.predicted for r in good]) > 0.97
    assert np.mean([1 - r.predicted for r in bad]) > 0.8
