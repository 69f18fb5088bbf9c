"""Boosting passes that sum half of a level and move bytes, and target statistics that are summed once per column."""

import numpy as np
import pytest

from spendlake.models import boosting as B


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random((n, 3)) < 0.05] = np.nan
    y = np.where(rng.random(n) < 0.3, 0.0, rng.gamma(2.0, np.exp(np.nan_to_num(x[:, 0])) / 2))
    rows = [(float(v), *[None if np.isnan(a) else float(a) for a in r]) for v, r in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, "y double, a double, b double, c double").repartition(3), x


def test_a_level_sums_one_child_of_two(spark, monkeypatch):
    df, x = table(spark)
    kw = dict(trees=4, depth=4, row_share=0.6, column_share=0.6, bins=16)
    one = B.fit(df, ["a", "b", "c"], **kw)
    asked, histograms = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda *a: (asked.append(len(a[-1])), histograms(*a))[1])
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(B, "PARTITION_ROWS", 100)
    for direct, cells in ((32, 1 << 17), (2, 0)):
        monkeypatch.setattr(B, "DIRECT_TASKS", direct)
        monkeypatch.setattr(B, "PAIR_CELLS", cells)
        many = B.fit(df, ["a", "b", "c"], **kw)  # the same draws, by the rows' stored numbers
        assert np.allclose(one.raw(one.bins(x)), many.raw(many.bins(x)), rtol=0, atol=1e-9)
    assert len(asked) == 2 * 4 * 4 and max(asked) <= 4  # 8 nodes at the last level


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_columns_walk_a_tree_as_rows_do(depth):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 40, (500, 4)).astype(np.uint8)
    size = 2 ** (depth + 1) - 1
    tree = B.Tree(np.full(size, -1), rng.integers(0, 40, size), rng.normal(size=size))
    for i in range(2**depth - 1):
        if i == 0 or (tree.feature[(i - 1) // 2] >= 0 and rng.random() < 0.95):
            tree.feature[i] = rng.integers(0, 4)
    assert np.array_equal(B._walk(tree, np.ascontiguousarray(bins.T)), tree.node_of(bins))
    assert len(np.unique(tree.node_of(bins))) > depth


def test_cells_of_two_features_add_up_to_those_of_one(monkeypatch):
    rng = np.random.default_rng(5)
    bins, slot, g, h = rng.integers(0, 9, (5, 300)).astype(np.uint8), rng.integers(0, 3, 300).astype(np.int16), rng.normal(size=300), rng.random(300)
    want = np.zeros((3, 5, 9, 3))
    for i in range(300):
        for j in range(5):
            want[slot[i], j, bins[j, i]] += g[i], h[i], 1
    assert np.allclose(B._cells(bins, slot, g, h, 3, 9), want)
    monkeypatch.setattr(B, "PAIR_CELLS", 0)
    assert np.allclose(B._cells(bins, slot, g, h, 3, 9), want)


def test_each_core_has_as_many_tasks():
    assert [B._partitions(n, 8) for n in (70_000, 500_000, 28_000_000, 168_000_000)] == [2, 8, 8, 24]
    assert B._partitions(1_000_000_000, 8) == 120


def test_target_statistics_are_summed_before_the_rows_are_joined(spark):
    rows = [(m, k, float(m + i), m < 4) for i, k in enumerate(["x", "y", None]) for m in range(6)]
    df = spark.createDataFrame([(*r, None if r[0] == 2 else r[2]) for r in rows], "m int, k string, y double, train boolean, z double")
    out = B.target_statistics(df, ["k"], "y", "m", 1.0, train="train")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Aggregate" not in text and text.count("broadcast") == 2
    got = {(r["m"], r["k"]): r["k__ts"] for r in out.collect()}
    # mean of month 0 is 1; level y has 1 there
    assert got[0, "x"] is None and got[1, "y"] == 1.0 and got[1, None] == 1.5 and got[4, "x"] == got[5, "x"] == (6 + 2.5) / 5
    gaps = B.target_statistics(df, ["k"], "z", "m", 1.0).where("m = 3 and k = 'x'").first()["k__ts"]
    assert gaps == (1 + 1.5) / 3
