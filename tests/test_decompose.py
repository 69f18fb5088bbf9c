"""The decomposition model, its search and its backtest against known truths."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlake.functions.joins import null_safe_join
from spendlake.models import decompose, tuning
from spendlake.operators.features import backtest_cutoffs, backtest_rows
from spendlake.plans import engine

START = dt.date(2016, 1, 1)


def daily(n, y):
    return pd.DataFrame({"ds": [START + dt.timedelta(days=i) for i in range(n)], "y": [float(y(i)) for i in range(n)]})


def test_solve_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 12))
    y = X[:, 0] * 3 - X[:, 5] * 2 + rng.normal(size=80) * 0.1
    ridge = np.r_[0.0, np.full(3, 0.5), np.zeros(8)]
    lasso = np.r_[np.zeros(4), np.full(8, 25.0)]
    b = decompose.solve(X.T @ X, X.T @ y, ridge, lasso)
    slope = X.T @ (X @ b - y) + ridge * b
    assert np.abs(slope[:4]).max() < 1e-6
    on = b[4:] != 0
    assert on.any() and not on.all()
    assert np.allclose(slope[4:][on], -25 * np.sign(b[4:][on]), atol=1e-5)
    assert (np.abs(slope[4:][~on]) <= 25 + 1e-5).all()


def test_two_changepoints_are_found_and_few_others():
    n = 1000
    cps = [320 / 999, 544 / 999]  # on the grid of 25 over the first 80 %
    y = lambda i: 50 + 0.02 * i + 0.3 * max(i - 320, 0) - 0.5 * max(i - 544, 0)
    noise = np.random.default_rng(4).normal(size=n) * 2
    hist = daily(n, lambda i: y(i) + noise[i])
    days = pd.to_datetime(hist["ds"]).values.astype("datetime64[D]").astype(np.int64).astype(float)
    p = decompose.settings({"changepoint_prior_scale": 0.001}, True)
    grid = np.linspace(0, 0.8, 26)[1:]
    X, pen, lasso = decompose._design(days, days[0], days[-1] - days[0], grid, True, p, None)
    scale = hist["y"].abs().max()
    var = (2 / scale) ** 2
    b = decompose.solve(X.T @ X, X.T @ hist["y"].to_numpy() / scale, var * pen, var * lasso)[2:27]
    big = np.abs(b) > 0.2 * np.abs(b).max()
    assert all(np.abs(grid[big] - c).min() < 0.035 for c in cps)
    assert all(min(abs(g - c) for c in cps) < 0.07 for g in grid[big])
    assert (b == 0).sum() >= 12
    fut = np.arange(days[-1] + 1, days[-1] + 60).astype(np.int64)
    yhat, _, _ = decompose.fit_predict(hist, fut, {}, True)
    want = [y(i) for i in range(n, n + 59)]
    assert np.abs(yhat - want).max() < 6


def test_the_band_widens_with_the_horizon():
    rng = np.random.default_rng(1)
    level = np.cumsum(np.cumsum(rng.normal(size=600) * 0.05))
    hist = daily(600, lambda i: level[i] + rng.normal())
    last = (START - dt.date(1970, 1, 1)).days + 599
    yhat, lo, hi = decompose.fit_predict(hist, np.arange(last + 1, last + 361), {}, True)
    assert (lo <= yhat).all() and (yhat <= hi).all()
    assert hi[-1] - lo[-1] > 1.5 * (hi[0] - lo[0])
    again = decompose.fit_predict(hist, np.arange(last + 1, last + 361), {}, True)
    assert all(np.array_equal(a, b) for a, b in zip((yhat, lo, hi), again, strict=True))


def frame(spark, n=420):
    rows = [(k, START + dt.timedelta(days=i), 10.0 + s * i + 5 * ((START + dt.timedelta(days=i)).weekday() == 5)) for k, s in (("a", 0.1), (None, 0.3)) for i in range(n)]
    rows += [("short", START, 1.0), ("short", START + dt.timedelta(days=400), 2.0), ("one", START, 1.0)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def test_backtest_is_a_refit_at_each_cutoff(spark):
    s = frame(spark)
    cut = backtest_cutoffs(s, ["k"], "ds", 180, 30, 90)
    want = {}
    for (k, c), g in backtest_rows(s, cut, ["k"], "ds", 90).toPandas().groupby(["k", "cutoff"], dropna=False):
        train, test = g[g.role == "train"].sort_values("ds"), g[g.role == "test"].sort_values("ds")
        if len(train) >= 2 and len(test):
            days = pd.to_datetime(test["ds"]).values.astype("datetime64[D]").astype(np.int64)
            for d, v in zip(test["ds"], decompose.fit_predict(train, days, {}, True)[0], strict=True):
                want[None if pd.isna(k) else k, c, d] = v
    got = {(r.k, r.cutoff, r.ds): r.yhat for r in decompose.backtest(s, ["k"]).collect()}
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 900
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_adaptive_search_beats_random_search():
    space = {"a": ("log", 1e-4, 1.0), "b": ("choice", "x", "y", "z"), "c": ("int", 1, 60), "d": ("real", 0.0, 1.0)}
    loss = lambda t: (np.log10(t["a"]) + 2.2) ** 2 + (t["b"] != "y") + ((t["c"] - 41) / 20) ** 2 + (t["d"] - 0.3) ** 2
    best = lambda startup, seed: min(v for _, v in tuning.search(loss, space, 60, seed, startup))
    adaptive, uniform = ([best(n, seed) for seed in range(20)] for n in (tuning.STARTUP, 99))
    assert np.median(adaptive) < 0.6 * np.median(uniform)
    assert sum(a < u for a, u in zip(adaptive, uniform, strict=True)) >= 13
    for t, _ in tuning.search(loss, space, 40, 3):
        assert 1e-4 <= t["a"] <= 1 and t["b"] in "xyz" and 1 <= t["c"] <= 60 and isinstance(t["c"], int) and 0 <= t["d"] <= 1
    with pytest.raises(ValueError):
        tuning.search(loss, space, 101)


def test_tuned_request_uses_what_it_is_given(spark, monkeypatch):
    """Holidays and given parameters reach search, fit and backtest, the backtest has each series' best."""
    n = 500
    flags = {START + dt.timedelta(days=i) for i in range(0, n + 100, 37)}
    rows = [(k, START + dt.timedelta(days=i), s * (100 + 0.05 * i + 80 * (START + dt.timedelta(days=i) in flags))) for k, s in (("a", 1.0), ("b", 2.0)) for i in range(n)]
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    holidays = spark.createDataFrame([(d, "h") for d in flags], "ds date, holiday string")
    given = {"tune": True, "trials": 3, "holidays": holidays, "changepoint_prior_scale": 0.4}
    seen = {}
    for name in ("forecast", "backtest"):
        real = getattr(decompose, name)

        def spy(*a, real=real, name=name, **kw):
            seen[name] = kw.get("per_series", a[7] if len(a) > 7 else None)
            return real(*a, **kw)

        monkeypatch.setattr(decompose, name, spy)
    fc, err = engine.ENGINES["prophet"](series, ["k"], 90, "day", given)
    best = {r.k: r for r in seen["backtest"].collect()}
    assert seen["forecast"] is seen["backtest"] and best.keys() == {"a", "b"}
    assert all(r.changepoint_prior_scale == 0.4 and r.trial >= 0 for r in best.values())
    fc = fc.withColumn("flag", F.col("ds").isin(*flags)).groupBy("k").agg(F.avg(F.expr("if(flag, yhat, null)")).alias("on"), F.avg(F.expr("if(flag, null, yhat)")).alias("off"))
    assert all(r.on > r.off + 60 for r in fc.collect())
    # a holiday table that the backtest did not see would leave errors of some 80 on those days
    rmse = {r.k: float(r.rmse) for r in err.collect()}
    assert rmse["a"] < 5 and rmse["b"] < 10
    joined = null_safe_join(series.select("k").distinct(), err, ["k"])
    assert joined.count() == 2
