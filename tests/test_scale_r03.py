"""What the steps must not do as tables grow: passes per row, kept batches, sorted joins, dates parsed twice, groups summed anew."""

import datetime as dt
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.functions.dates import parse_date_any
from spendlake.models import boosting as B
from spendlake.operators import ledger as L
from spendlake.plans import forecasting
from spendlake.session import shared_path
from spendlake.sources import tables
from spendlake.streaming import ingest as ST
from spendlake.streaming.ledger_table import LedgerTable

DAY = dt.datetime(2020, 1, 5)


@pytest.fixture
def small(spark, tmp_path):
    """Tables of four line items, one of an order that is not there."""
    made = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "c1", 0, "S"), (2, "c2", 0, "T")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(1, "P"), (2, "Q")], "p_partkey long, p_type string"),
        "orders": ([(1, 1), (2, 2)], "o_orderkey long, o_custkey long"),
        "lineitem": (
            [(1, 1, 10.0, 0.1, DAY, "R"), (1, 2, 20.0, 0.0, DAY, "N"), (2, 2, 5.0, 0.5, DAY, None), (9, 1, 1.0, 0.0, DAY, "N")],
            "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double, l_shipdate timestamp, l_returnflag string",
        ),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boosting_packs_its_working_table(spark):
    src = spark.range(1000).select(F.col("id").cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("f0"))
    model = B.Model(["a"], [np.array([1.0, 3.0])], 0.0, "squared")
    state = B._binned(src, model, 2)
    got = state.collect()
    assert len(got) < 20
    assert sorted(np.concatenate([np.frombuffer(r["y"]) for r in got])) == list(range(1000))
    tree = B.Tree(np.array([0, -1, -1]), np.array([0, 0, 0]), np.array([0.0, 1.0, 2.0]))
    for r in B._add_tree(state, 1, tree).collect():
        assert np.array_equal(np.frombuffer(r["raw"]), np.where(np.frombuffer(r["y"]) % 7 <= 1, 1.0, 2.0))


def test_stream_batches_are_not_kept(spark, monkeypatch):
    kept, append = [], LedgerTable.append
    monkeypatch.setattr(LedgerTable, "append", lambda t, batch, epoch: (kept.append(batch.is_cached), append(t, batch, epoch))[1])
    schema = "date date, service_name string, account_name string, spend decimal(18,2), bu_code int, segment string, sync_id bigint"
    landing = shared_path(spark, "t-kept")
    day = DAY.date()
    spark.createDataFrame([(day, "s", "a", Decimal(2), None, "x", 1), (day, "s", "a", Decimal(3), 4, None, 1), (day, None, "a", Decimal(1), 5, "z", None)], schema).coalesce(1).write.parquet(f"{landing}/0")
    time.sleep(1.1)
    spark.createDataFrame([(day, "s", "a", Decimal(7), 9, "y", 1)], schema).coalesce(1).write.parquet(f"{landing}/1")
    source = spark.read.parquet(f"{landing}/0").schema
    out = ST.ledger_ingest_stream(spark, landing, source, shared_path(spark, "t-kept-sink"), shared_path(spark, "t-kept-ckpt"), max_files=1)
    assert {tuple(r) for r in out.select("service_name", "spend", "bu_code", "segment").collect()} == {("s", Decimal(12), 4, "x"), (None, Decimal(1), 5, "z")}
    assert kept == [False, False]


def test_ledger_joins_without_sorts(spark, small, monkeypatch):
    monkeypatch.setattr(tables, "bounded_broadcast", lambda df, n: df)  # as if every side were large
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = tables.derive_ledger(spark, small)
        text = df._jdf.queryExecution().executedPlan().toString()
        got = {(r["account_name"], r["service_name"], r["spend"], r["usage_family"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # nation and region, a few rows, may be merged; the others not
    assert text.count("ShuffledHashJoin") == 3
    assert got == {("c1", "P", Decimal("9.00"), "R"), ("c1", "Q", Decimal("20.00"), "N"), ("c2", "Q", Decimal("2.50"), None)}


def test_dates_are_parsed_once(spark):
    raw = spark.createDataFrame([("2024-01-02", "1", "s", "a"), (" ", "1", "s", "a"), (None, "1", "s", "a")], "date string, spend string, serviceName string, accountName string")
    out = L.normalise_raw(raw)
    assert [r["date"] for r in out.collect()] == [dt.date(2024, 1, 2)]
    assert not any("Filter" in line and "gettimestamp" in line for line in plan(out).splitlines())


def test_plain_dates_equal_the_formats_tried_in_turn(spark):
    texts = ["2024-02-29", "2023-02-29", "2023-13-01", "02/30/2023", "12/31/1999", "13/01/2020", "2020-05", "2020-13", "0000-01-01", "01/02/0000", "0000-01", "2020-1-2", "2020/03/04", "2020-01-02 03:04:05", "2020-01-02T03:04:05Z", "1/2/2020", "x", "", " 2020-07 ", "2020-01-01\n", "1582-10-10", "0001-01-01"]
    from spendlake.functions import dates

    s = F.trim(F.col("t"))
    chain = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in dates.DATE_FORMATS], s.try_cast("timestamp")).cast("date")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date_any(F.col("t")).cast("string").alias("a"), chain.cast("string").alias("b"))
    assert [(r["t"], r["a"]) for r in df.collect()] == [(r["t"], r["b"]) for r in df.collect()]


def test_monthly_groups_are_written_once(spark, small):
    frame = forecasting._legacy_frame(spark, small)
    assert "Aggregate" not in plan(frame) and frame.count() == 3
