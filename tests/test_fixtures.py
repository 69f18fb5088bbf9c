"""Hand fixtures for paths the driver tables cannot exercise (nulls, gaps, duplicates, edges)."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.functions.dates import parse_date_any, weekday_mon0
from spendlake.functions.money import currency_text
from spendlake.models import decompose, linear
from spendlake.operators import calendar, features, ledger as L, metrics as MX, profile as P
from spendlake.sources import providers as PV

D = dt.date


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_gaps_are_zero_filled(spark):
    df = spark.createDataFrame(
        [(D(2020, 1, 15), Decimal("10.00"), "a"), (D(2020, 4, 2), Decimal("5.00"), "a"), (D(2020, 5, 9), Decimal("1.00"), "a")],
        "date date, spend decimal(14,2), k string",
    )
    out = sorted(rows(calendar.resample(df, ["k"], "month"), "ds", "y"))
    assert [r[0] for r in out] == [D(2020, m, 1) for m in range(1, 6)]
    assert [float(r[1]) for r in out] == [10.0, 0.0, 0.0, 5.0, 1.0]


def test_resample_daily_and_sum_invariant(spark):
    df = spark.createDataFrame(
        [(D(2021, 1, 1), Decimal("1.10")), (D(2021, 1, 4), Decimal("2.20")), (D(2021, 1, 4), Decimal("3.30"))],
        "date date, spend decimal(14,2)",
    )
    out = calendar.resample(df, [], "day")
    assert out.count() == 4
    assert out.agg(F.sum("y")).first()[0] == Decimal("6.60")


def test_null_keys_and_dates(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "1.00", None, "acct"), ("2020-01-02", "2.00", "svc", None), (None, "3.00", "svc", "acct")],
        "date string, spend string, serviceName string, accountName string",
    )
    out = L.normalise_raw(df)
    got = sorted(rows(out, "service_name", "account_name"))
    assert got == [("Unallocated", "acct"), ("svc", "Unallocated")]


def test_dup_keys_first_non_null_and_sum(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, 1), "s", "a", Decimal("1.00"), None), (2, D(2020, 1, 1), "s", "a", Decimal("2.00"), 7), (3, D(2020, 1, 1), "s", "a", Decimal("3.00"), 8)],
        "seq int, date date, service_name string, account_name string, spend decimal(14,2), bu_code int",
    )
    r = L.squash(df, order_col="seq").first()
    assert r["spend"] == Decimal("6.00") and r["bu_code"] == 7


def test_bad_numbers_coerce_to_zero(spark):
    df = spark.createDataFrame([("12.50",), ("abc",), ("",), (None,)], "spend string")
    got = [r[0] for r in df.select(L.coerce_spend("spend")).collect()]
    assert got == [Decimal("12.500000"), Decimal("0E-6"), Decimal("0E-6"), Decimal("0E-6")]


def test_sub_cent_rounds_after_sum(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), "s", "a", "0.004")] * 400, "date date, service_name string, account_name string, spend string")
    df = df.withColumn("spend", L.coerce_spend("spend"))
    assert L.squash(df, first_cols=()).first()["spend"] == Decimal("1.60")


def test_rank_edge_zero_keeps_slot_and_other_only_if_positive(spark):
    data = [(f"acct{i:02d}", Decimal(str(100 - i))) for i in range(10)]
    data += [("zero", Decimal("0")), ("neg", Decimal("-5")), ("tail", Decimal("3"))]
    df = spark.createDataFrame(data, "account_name string, spend decimal(14,2)")
    out = {r["name"]: (r["total_spend"], r["rank"]) for r in P.top_n_other(df, "account_name", 10).collect()}
    # 10 positive accounts fill ranks 1..10; "tail" (3) + "zero" + "neg" (-5) sum to -2: no Other
    assert len(out) == 10 and "Other" not in out
    out2 = {r["name"]: r["total_spend"] for r in P.top_n_other(df, "account_name", 9).collect()}
    # rank 10 is acct09 (91), then tail 3, zero, neg: Other = 91 + 3 + 0 - 5
    assert out2["Other"] == Decimal("89.00")
    df0 = spark.createDataFrame([("a", Decimal("5")), ("b", Decimal("0")), ("c", Decimal("1"))], "account_name string, spend decimal(14,2)")
    got = {r["name"]: r["rank"] for r in P.top_n_other(df0, "account_name", 2).collect()}
    assert got == {"a": 1, "c": 2}  # 'c' (1) ranks 2nd; 'b' (0) is the tail, and a 0 tail emits no Other


def test_uncategorized_label(spark):
    df = spark.createDataFrame([(None, Decimal("5")), ("", Decimal("4"))], "account_name string, spend decimal(14,2)")
    names = sorted(r["name"] for r in P.top_n_other(df, "account_name", 10).collect())
    assert names == ["Uncategorized", "Uncategorized"]


def test_resync_replaces_spend_only_and_is_idempotent(spark):
    old = spark.createDataFrame([(D(2020, 1, 1), "s", "a", Decimal("1.00"), 1, "x")], "date date, service_name string, account_name string, spend decimal(18,2), bu_code int, segment string")
    upd = spark.createDataFrame(
        [(D(2020, 1, 1), "s", "a", Decimal("9.00"), 2, "y"), (D(2020, 1, 2), "s", "a", Decimal("4.00"), 3, "z")],
        "date date, service_name string, account_name string, spend decimal(18,2), bu_code int, segment string",
    )
    once = L.upsert(old, upd)
    twice = L.upsert(once, upd)
    a = sorted(rows(once, "date", "spend", "bu_code", "segment"))
    assert a == [(D(2020, 1, 1), Decimal("9.00"), 1, "x"), (D(2020, 1, 2), Decimal("4.00"), 3, "z")]
    assert sorted(rows(twice, "date", "spend", "bu_code", "segment")) == a


def test_short_history_tail_fallbacks(spark):
    pts = {"one": 1, "two": 2, "five": 5, "eleven": 11}
    data = [(k, D(2020 + (i // 12), i % 12 + 1, 1), Decimal(i + 1)) for k, n in pts.items() for i in range(n)]
    df = spark.createDataFrame(data, "k string, ds date, y decimal(18,2)")
    t = {r["k"]: r for r in features.tail_features(df, ["k"]).collect()}
    assert t["one"]["lag_12"] == Decimal("1") and t["one"]["rolling_mean_3"] == Decimal("1")
    assert t["five"]["lag_3"] == Decimal("3") and t["five"]["rolling_mean_3"] == Decimal("4")
    assert t["five"]["lag_6"] == Decimal("5")  # fewer than 6 points: last value
    assert t["eleven"]["rolling_mean_6"] == Decimal("8.5")


def test_ar1_short_history_carries_last_value(spark):
    df = spark.createDataFrame([("k", D(2020, 1, 1), Decimal("5.00"))], "k string, ds date, y decimal(18,2)")
    out = linear.ar1_recursive(df, ["k"], 3).collect()
    assert [r["yhat"] for r in out] == [5.0, 5.0, 5.0]


def test_trend_season_recovered(spark):
    data = [("k", D(2015 + t // 12, t % 12 + 1, 1), 100 + 2 * t + 10 * math.sin(2 * math.pi * t / 12)) for t in range(60)]
    df = spark.createDataFrame(data, "k string, ds date, y double")
    fc = decompose.forecast(df, ["k"], 12, "month").orderBy("ds").collect()
    truth = [100 + 2 * t + 10 * math.sin(2 * math.pi * t / 12) for t in range(60, 72)]
    err = np.abs(np.array([r["yhat"] for r in fc]) - np.array(truth))
    assert len(fc) == 12 and err.max() < 6.0
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in fc)


def test_prophet_style_smoke_24_daily(spark):
    data = [("k", D(2023, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(24)]
    df = spark.createDataFrame(data, "k string, ds date, y double")
    fc = decompose.forecast(df, ["k"], 24, "day")
    assert fc.count() == 24 and set(fc.columns) >= {"ds", "yhat", "yhat_lower", "yhat_upper"}


def test_unseen_level_gets_all_zero_dummies(spark):
    from spendlake.models import legacy

    train = spark.createDataFrame(
        [(c, D(2020, m, 1), float(10 * m + i)) for i, c in enumerate(["b", "c", "d"]) for m in range(1, 13)],
        "service_name string, month date, spend double",
    )
    frame = legacy.monthly_groups(train.withColumnRenamed("month", "date"), ["service_name"])
    model = legacy.fit_regressor(frame, ["service_name"], "linear")
    score = frame.limit(1).withColumn("service_name", F.lit("zzz"))
    mapped = legacy.map_unseen_levels(score, model, ["service_name"])
    assert mapped.first()["service_name"] == "b"
    vec = model.stages[1].transform(model.stages[0].transform(mapped)).first()["service_name__v"]
    assert vec.numNonzeros() == 0


def test_cold_headers(spark):
    df = spark.createDataFrame([("2020-03", "04/15/2020", "7.5", "x")], "`month` string, `Date` string, ` cost ` string, `Service` string")
    df = L.canonicalise(L.strip_header(df))
    out = L.normalise_raw(df).first()
    assert out["date"] == D(2020, 3, 1)  # month wins over Date
    assert out["spend"] == Decimal("7.500000")
    assert out["service_name"] == "Unallocated"  # 'Service' is not an alias (case-sensitive)


def test_gcp_null_credits(spark):
    df = spark.createDataFrame(
        [(None,), ([],), ([{"amount": Decimal("-1.5")}, {"amount": Decimal("-2.5")}],)],
        "credits array<struct<amount: decimal(20,6)>>",
    )
    got = [r[0] for r in df.select(PV.credit_total(F.col("credits"))).collect()]
    assert got == [Decimal("0E-6"), Decimal("0E-6"), Decimal("-4.000000")]


def test_aws_roundtrip(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), "svc", "acct", Decimal("1.23"))], "date date, service_name string, account_name string, spend decimal(18,2)")
    out = PV.flatten_aws(PV.pack_aws(df)).first()
    assert (out["date"], out["service_name"], out["account_name"], out["spend"]) == (D(2020, 1, 1), "svc", "acct", Decimal("1.230000"))


def test_parse_and_weekday(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02",), ("03/15/2024",), ("junk",)], "s string")
    got = [r[0] for r in df.select(parse_date_any(F.col("s"))).collect()]
    assert got == [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 15), None]
    assert spark.range(1).select(weekday_mon0(F.lit(D(2024, 1, 1)))).first()[0] == 0  # a Monday


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ["0", "5", "10"]], "spend decimal(14,2)")
    h = {r["bin"]: r["n"] for r in P.spend_histogram(df, bins=5).collect()}
    assert h == {1: 1, 3: 1, 5: 1}


def test_percentiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 10_000, 101)]
    df = spark.createDataFrame([(v,) for v in vals], "spend double")
    got = {r["percentile"]: r["spend_value"] for r in P.spend_percentiles(df).collect()}
    for p in P.PERCENTILES:
        assert got[p] == pytest.approx(np.percentile(vals, p))


def test_error_metrics_against_numpy(spark):
    y = [100.0, 200.0, 0.5, 50.0]
    p = [110.0, 190.0, 1.0, 55.0]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(y, p)], "k string, y double, yhat double")
    m = MX.error_metrics(df, ["k"]).first()
    e = np.array(y) - np.array(p)
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean(e**2)), abs=1e-4)
    assert m["mae"] == pytest.approx(np.mean(np.abs(e)), abs=1e-4)
    assert m["mape"] == pytest.approx(np.mean(np.abs(e) / np.abs(y)), abs=1e-6)
    assert m["r2"] == pytest.approx(1 - np.sum(e**2) / np.sum((np.array(y) - np.mean(y)) ** 2), abs=1e-6)


def test_output_adapter_band(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 100.0), (D(2020, 2, 1), 0.0)], "date date, forecast double")
    out = {r["ds"]: (r["yhat_lower"], r["yhat_upper"]) for r in MX.output_adapter(df).collect()}
    assert out[D(2020, 1, 1)] == pytest.approx((90.0, 110.0)) and out[D(2020, 2, 1)] == (0.0, 0.0)


def test_currency_text(spark):
    df = spark.createDataFrame([(0.0,), (1.5e9,), (2.25e6,), (4321.0,), (12.0,)], "v double")
    assert [r[0] for r in df.select(currency_text("v")).collect()] == ["$0", "$1.5B", "$2.3M", "$4k", "$12"]


def test_folds_and_cutoffs(spark):
    data = [("k", D(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, ds date, y double")
    cuts = sorted(r["cutoff"] for r in features.backtest_cutoffs(df, ["k"]).collect())
    last = D(2020, 1, 1) + dt.timedelta(days=399)
    assert cuts[-1] == last - dt.timedelta(days=90)
    assert cuts[0] >= D(2020, 1, 1) + dt.timedelta(days=180)
    folds = features.expanding_folds(df, ["k"]).groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in folds}[(0, "val")] == 100


def test_distributed_exact_quantiles_match_numpy_with_hot_value(spark):
    from spendlake.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(7)
    a = list(rng.normal(100, 30, 3000).round(2)) + [42.0] * 1500  # a third of the rows share one value
    b = [5.0]  # a group of one
    c = list(rng.integers(0, 10, 50).astype(float))  # many ties
    rows = [("a", float(x)) for x in a] + [("b", x) for x in b] + [("c", float(x)) for x in c]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["qi"]): r["value"] for r in exact_quantiles(df, ["g"], "v", qs, buckets=16).collect()}
    for name, vals in (("a", a), ("b", b), ("c", c)):
        for i, q in enumerate(qs):
            assert got[(name, i)] == pytest.approx(np.quantile(vals, q), abs=1e-9)


def test_rolling_global_scope_crosses_series(spark):
    df = spark.createDataFrame(
        [("a", D(2020, m, 1), Decimal(m)) for m in range(1, 4)] + [("b", D(2020, m, 1), Decimal(10 * m)) for m in range(1, 4)],
        "k string, ds date, y decimal(18,2)",
    )
    per = {(r["k"], r["ds"]): r["rolling_mean_3"] for r in features.add_rolling_means(df, ["k"], ["ds"], "y", [3]).collect()}
    glob = {(r["k"], r["ds"]): r["rolling_mean_3"] for r in features.add_rolling_means(df, ["k"], ["ds"], "y", [3], scope="global").collect()}
    assert per[("b", D(2020, 3, 1))] is None  # only 2 previous values inside series b
    # flattened: lag-1 values (null, 1, 2, null, 10, 20) roll across the a/b boundary
    assert glob[("a", D(2020, 3, 1))] is None and glob[("b", D(2020, 3, 1))] is None
    assert glob[("b", D(2020, 2, 1))] is None


def test_engine_rejects_unknown_model_and_params(spark):
    from spendlake.plans.engine import run_forecast

    df = spark.createDataFrame([(D(2020, 1, 1), Decimal("1.00"), "a", "s", 1, "x")], "date date, spend decimal(14,2), account_name string, service_name string, bu_code int, segment string")
    with pytest.raises(ValueError, match="Unsupported ML Model"):
        run_forecast(df, model_name="arima")
    with pytest.raises(ValueError, match="unknown hyperparameters"):
        run_forecast(df, model_name="xgboost", hyperparameters={"depth": 4})
    with pytest.raises(ValueError):
        run_forecast(df, model_name="prophet", hyperparameters=[1, 2])


def test_random_search_trees_small_space(spark):
    from spendlake.models import tuning

    data = [(k, D(2015 + t // 12, t % 12 + 1, 1), Decimal(100 + 3 * t + (7 if k == "b" else 0))) for k in ("a", "b") for t in range(40)]
    df = spark.createDataFrame(data, "k string, ds date, y decimal(18,2)")
    out = tuning.random_search_gbt(df, ["k"], n_trials=2, parallelism=2, space={"maxIter": (3, 5), "maxDepth": (2, 3)}).collect()
    assert len(out) == 2 and sum(r["selected"] for r in out) == 1
    assert all(r["val_rmse"] >= 0 and 3 <= r["params"]["maxIter"] <= 5 for r in out)


def test_stream_ingest_versioned_sink_out_of_order_and_replay(spark):
    import time as _time

    from spendlake.session import shared_path
    from spendlake.streaming import ingest as ST

    schema = "date date, service_name string, account_name string, spend decimal(18,2), bu_code int, segment string, sync_id bigint"
    newer = spark.createDataFrame([(D(2020, 1, 5), "s", "a", Decimal("12.00"), 1, "x", 2), (D(2020, 1, 6), "s", "a", Decimal("3.00"), 1, "x", 2)], schema)
    older = spark.createDataFrame([(D(2020, 1, 5), "s", "a", Decimal("10.00"), 1, "x", 1), (D(2020, 1, 4), "s", "a", Decimal("7.00"), 1, "x", 1)], schema)
    landing = shared_path(spark, "t-landing")
    for name, part in (("first", newer), ("late", older)):  # a revision, a late older delivery, then a replay
        part.coalesce(1).write.parquet(f"{landing}/{name}")
        _time.sleep(1.1)  # distinct modification times: the file source orders by them
    ST.redeliver(spark, f"{landing}/first", f"{landing}/again")
    out = ST.ledger_ingest_stream(spark, landing, spark.read.parquet(f"{landing}/first").schema, shared_path(spark, "t-sink"), shared_path(spark, "t-ckpt"), max_files=1)
    got = {r["date"]: r["spend"] for r in out.collect()}
    assert got == {D(2020, 1, 4): Decimal("7.00"), D(2020, 1, 5): Decimal("12.00"), D(2020, 1, 6): Decimal("3.00")}


def test_quantile_methods_agree(spark):
    vals = [Decimal(str(x)) for x in np.random.default_rng(3).integers(1, 5000, 301) / 100]
    df = spark.createDataFrame([(D(2021, 1 + i % 3, 1), v) for i, v in enumerate(vals)], "date date, spend decimal(14,2)")
    dist = {r["month"]: r["median_spend"] for r in P.monthly_profile(df).collect()}
    built = {r["month"]: r["median_spend"] for r in P.monthly_profile(df, method="builtin").collect()}
    approx = {r["month"]: r["median_spend"] for r in P.monthly_profile(df, method="approx").collect()}
    assert dist == built
    assert all(abs(approx[m] - dist[m]) <= 50 for m in dist)  # GK sketch: a nearby sample value
