"""Histogram boosting against a brute-force split search, and target statistics that see no own label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.models import boosting as B


def brute_tree(x, g, h, edges, depth, l2, min_weight, rate):
    """Predictions of a tree grown by trying every cut of every feature in every node."""
    out = np.zeros(len(x))

    def grow(rows, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + l2)
        best = (1e-12, None)
        if level < depth:
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
            for j in range(x.shape[1]):
                for e in [*edges[j], np.inf]:
                    left = rows & (x[:, j] <= e)
                    right = rows & ~left
                    if left.any() and right.any() and h[left].sum() >= min_weight and h[right].sum() >= min_weight:
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] + 1e-9 * max(abs(gain), 1.0):
                            best = (gain, (left, right))
        if best[1] is None:
            out[rows] = value
        else:
            for part in best[1]:
                grow(part, level + 1)

    grow(np.ones(len(x), bool), 0)
    return out


def table(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random((n, 3)) < 0.05] = np.nan
    mu = np.exp(0.8 * np.nan_to_num(x[:, 0]) + (np.nan_to_num(x[:, 1]) > 0.3))
    y = np.where(rng.random(n) < 0.3, 0.0, rng.gamma(2.0, mu / 2))
    rows = [(float(v), *[None if np.isnan(a) else float(a) for a in r]) for v, r in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, "y double, a double, b double, c double").repartition(3), x, y


@pytest.mark.parametrize("loss", ["tweedie", "squared"])
def test_trees_equal_a_brute_force_search(spark, loss, monkeypatch):
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    df, x, y = table(spark)
    m = B.fit(df, ["a", "b", "c"], loss=loss, trees=5, depth=3, rate=0.3, bins=16, l2=0.5, min_weight=2.0)
    raw = np.full(len(y), m.base)
    for k in range(5):
        g, h = B.gradients(loss, 1.5, y, raw)
        raw = raw + brute_tree(x, g, h, m.edges, 3, 0.5, 2.0, 0.3)
        assert np.allclose(m.raw(m.bins(x), k + 1), raw, atol=1e-8), k
    if loss == "tweedie":
        dev = [B.tweedie_deviance(y, p) for p in m.staged(m.bins(x), [0, 1, 3, 5])]
        assert dev == sorted(dev, reverse=True) and dev[-1] < 0.8 * dev[0]
    got = {(r.y, r.a, r.b, r.c): r.prediction for r in B.predict(df, m).collect()}
    for v, r, p in zip(y, x, m.link(raw), strict=True):
        assert abs(got[(float(v), *[None if np.isnan(a) else float(a) for a in r])] - p) < 1e-8


def test_many_tasks_sum_to_the_same_trees(spark, monkeypatch):
    df, x, _ = table(spark)
    kw = dict(trees=3, depth=3, row_share=1.0, column_share=0.6, bins=16)
    one = B.fit(df, ["a", "b", "c"], **kw)
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    for rows, direct in ((400, 32), (40, 32), (40, 2)):
        monkeypatch.setattr(B, "PARTITION_ROWS", rows)
        monkeypatch.setattr(B, "DIRECT_TASKS", direct)
        many = B.fit(df, ["a", "b", "c"], **kw)
        assert np.allclose(one.raw(one.bins(x)), many.raw(many.bins(x)), atol=1e-9)
    half = B.fit(df, ["a", "b", "c"], trees=3, depth=3, row_share=0.5, bins=16)
    assert not np.allclose(one.raw(one.bins(x)), half.raw(half.bins(x)))


def test_derivatives_are_those_of_the_deviance():
    y, raw, e = np.array([0.0, 0.5, 3.0]), np.array([0.2, -1.0, 1.5]), 1e-5
    half = lambda f: np.array([B.tweedie_deviance(np.array([v]), np.array([np.exp(s)])) / 2 for v, s in zip(y, f, strict=True)])
    g, h = B.gradients("tweedie", 1.5, y, raw)
    assert np.allclose(g, (half(raw + e) - half(raw - e)) / (2 * e), atol=1e-6)
    assert np.allclose(h, (half(raw + e) - 2 * half(raw) + half(raw - e)) / e**2, atol=1e-3)


def test_bad_input(spark):
    df = spark.createDataFrame([(-1.0, 1.0)], "y double, a double")
    with pytest.raises(ValueError, match="labels of 0"):
        B.fit(df, ["a"])
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), ["a"])
    with pytest.raises(ValueError, match="loss"):
        B.fit(df, ["a"], loss="log")
    one = B.fit(df, ["a"], loss="squared", trees=2)
    assert [r.prediction for r in B.predict(df, one).collect()] == [-1.0]


def test_target_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(int(m), None if rng.random() < 0.2 else f"k{rng.integers(40)}", float(rng.integers(100)), bool(m < 8)) for m in rng.integers(0, 12, 500)]
    df = spark.createDataFrame(rows, "m int, k string, y double, train boolean")
    got = sorted(map(tuple, B.target_statistics(df, ["k"], "y", "m", 2.0, train="train").collect()), key=str)
    want = []
    for m, k, y, t in rows:
        old = [r for r in rows if r[0] < m and r[3]]
        mine = [r[2] for r in old if r[1] == k]
        mean = np.mean([r[2] for r in old]) if old else None
        want.append((m, k, y, t, None if mean is None else (sum(mine) + 2 * mean) / (len(mine) + 2)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 1e-9)
    # changing labels of a period changes nothing in it or before
    other = df.withColumn("y", F.when(F.col("m") == 5, F.col("y") + 1000).otherwise(F.col("y")))
    after = B.target_statistics(other, ["k"], "y", "m", 2.0, train="train").where("m <= 5").select("m", "k", "k__ts")
    before = B.target_statistics(df, ["k"], "y", "m", 2.0, train="train").where("m <= 5").select("m", "k", "k__ts")
    assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
