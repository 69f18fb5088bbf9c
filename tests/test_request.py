"""The forecast request: guards, backtest metrics, tuning, steps and parameters."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from spendlake.models import decompose, tuning
from spendlake.plans.engine import run_forecast

D = dt.date
LEDGER = "date date, spend decimal(14,2), account_name string, service_name string, bu_code int, segment string"


def ledger(spark):
    rows = [(D(2018 + m // 12, m % 12 + 1, 5), Decimal(100 + 2 * m + b), f"acc{b}", "s", None if b else 1, None if b else "x") for m in range(48) for b in (0, 1)]
    rows.append((D(2020, 1, 1), Decimal(7), "late", "s", 9, "one point"))
    return spark.createDataFrame(rows, LEDGER)


def test_request_guards(spark):
    lg = ledger(spark)
    with pytest.raises(ValueError, match="segment_name is required"):
        run_forecast(lg, "segment", single_series=True)
    with pytest.raises(ValueError, match="no ledger rows"):
        run_forecast(lg, "account", account_name="nobody")
    with pytest.raises(ValueError, match="granularity"):
        run_forecast(lg, granularity="hourly")


def test_default_engine_reports_its_backtest_and_keeps_null_series(spark):
    fc, hist, kpis = run_forecast(ledger(spark), "segment", "monthly")
    rows = {r.segment: r for r in kpis.collect()}
    assert rows.keys() == {None, "x", "one point"} == {r.segment for r in fc.select("segment").distinct().collect()}
    assert rows["x"].rmse is not None and rows[None].rmse is not None
    assert rows["one point"].rmse is None and "insufficient" in rows["one point"].reason
    assert {r["count"] for r in fc.groupBy("segment").count().collect()} == {24}


@pytest.mark.parametrize(("granularity", "first", "n"), [("weekly", D(2021, 12, 6), 52), ("yearly", D(2022, 1, 1), 5)])
def test_steps(spark, granularity, first, n):
    fc, _, _ = run_forecast(ledger(spark), granularity=granularity)
    ds = sorted(r.ds for r in fc.collect())
    assert ds[0] == first and len(ds) == n


def test_tuned_request_and_short_series(spark):
    lg = ledger(spark)
    fc, _, _ = run_forecast(lg, "segment", hyperparameters={"tune": True, "trials": 3})
    assert {r.segment for r in fc.select("segment").distinct().collect()} == {None, "x", "one point"}
    series = spark.createDataFrame([("a", D(2020, 1, 1), 1.0)] + [("b", D(2020 + m // 12, m % 12 + 1, 1), float(m)) for m in range(24)], "k string, ds date, y double")
    got = {r.k: r for r in tuning.tune_decompose(series, ["k"], 4).collect()}
    assert got["a"].trial == -1 and got["a"].rmse is None and got["a"].changepoint_prior_scale == 0.05
    assert got["b"].trial >= 0 and got["b"].rmse >= 0


@pytest.mark.parametrize("n", range(0, 30))
def test_folds_never_train_on_what_they_validate(n):
    folds = tuning.fold_bounds(n, 3)
    assert bool(folds) == (n >= 3)
    assert all(2 <= a < b <= n for a, b in folds) and (not folds or folds[-1][1] == n)
    assert all(x[1] == y[0] for x, y in zip(folds, folds[1:], strict=False))


def test_parameters_are_used_as_given():
    hist = pd.DataFrame({"ds": pd.date_range("2018-01-01", periods=36, freq="MS"), "y": -50.0 + 10 * np.sin(np.arange(36))})
    days = np.array([19000, 19031])
    widths = []
    for w in (0.5, 0.8, 0.99):
        _, lo, hi = decompose.fit_predict(hist, days, {"interval_width": w}, False)
        widths.append(float(hi[0] - lo[0]))
    assert widths[0] < widths[1] < widths[2]
    credits, _, _ = decompose.fit_predict(hist, days, {"seasonality_mode": "multiplicative"}, False)
    assert (credits < 0).all()
    low, _, _ = decompose.fit_predict(hist, days, {"yearly_order": 5}, False)
    high, _, _ = decompose.fit_predict(hist, days, {"yearly_order": 9}, False)
    assert not np.allclose(low, high)
    for bad in ({"order": 1}, {"interval_width": 1.5}):
        with pytest.raises(ValueError):
            decompose.fit_predict(hist, days, bad, False)
