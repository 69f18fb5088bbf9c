"""Ingest rules that lose no money and no rows: syncs, dates, CSV headers, order, null keys."""

import datetime as dt
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlake.functions.joins import null_safe_join
from spendlake.operators import ledger as L
from spendlake.operators import metrics as MX
from spendlake.operators import profile as P
from spendlake.session import shared_path
from spendlake.sources.csv_ledger import ingest_csv, read_csv_export
from spendlake.streaming import ingest as ST
from spendlake.streaming.ledger_table import LedgerTable

D = dt.date


SYNC = "date date, service_name string, account_name string, spend decimal(18,2), bu_code int, segment string, sync_id bigint"


def land(spark, landing, parts):
    """Each part a file in a folder of its own, in order of time; an integer delivers that part's file again."""
    for i, rows in enumerate(parts):
        if isinstance(rows, int):
            ST.redeliver(spark, f"{landing}/{rows}", f"{landing}/{i}")
        else:
            spark.createDataFrame(rows, SYNC).coalesce(1).write.parquet(f"{landing}/{i}")
        time.sleep(1.1)


def test_sync_rows_add_up_and_later_syncs_replace_spend_only(spark):
    day = D(2020, 1, 5)
    landing = shared_path(spark, "t-parts")
    land(spark, landing, [
        [(day, "s", "a", Decimal(10), None, "x", 1), (day, "s", "a", Decimal(5), 1, "y", 1), (day, None, "a", Decimal(1), 3, None, 1)],
        [(day, "s", "a", Decimal(2), 9, "z", 1)],  # the same sync, another file and batch
        [(day, "s", "b", Decimal(7), 1, "x", 1)],
        [(day, "s", "b", Decimal(3), 99, "zzz", 2), (day, "s", "b", Decimal(4), 98, "zz", 2)],  # a revision
        2,  # a late file, delivered again
        1,  # delivered again
        [(day, "s", "a", Decimal(2), 9, "z", 1)],  # another file with equal rows: it adds up
        [(day, "s", "b", Decimal(100), 5, "late", 1)],  # an older sync after a newer one
    ])
    for max_files in (1, 8, None):
        out = ST.ledger_ingest_stream(spark, landing, spark.read.parquet(f"{landing}/0").schema, shared_path(spark, "t-s"), shared_path(spark, "t-c"), max_files)
        got = {(r.service_name, r.account_name): (r.spend, r.bu_code, r.segment) for r in out.collect()}
        assert got == {
            ("s", "a"): (Decimal("19.00"), 1, "x"),
            ("s", "b"): (Decimal("7.00"), 1, "x"),
            (None, "a"): (Decimal("1.00"), 3, None),
        }


def test_compaction_changes_no_result(spark):
    rnd = random.Random(3)
    days = [D(2020, m, 3) for m in (1, 2, 3)]
    batches = [
        [(rnd.choice(days), rnd.choice("st"), rnd.choice([None, "a", "b"]), Decimal(rnd.randrange(100)), rnd.choice([None, 1, 2]), rnd.choice([None, "x"]), rnd.choice([None, 1, 2, 3, 4])) for _ in range(12)]
        for _ in range(6)
    ]
    landing = shared_path(spark, "t-batches")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SYNC).coalesce(1).write.parquet(f"{landing}/{i}")
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    kinds = [dict(compact_deltas=99), dict(compact_deltas=2), dict(compact_bytes=1)]
    tables = [LedgerTable(spark, shared_path(spark, "t-table"), **k) for k in kinds]
    for t in tables:
        assert t.read() is None
        for i, epoch in ((0, 0), (1, 1), (2, 2), (2, 2), (3, 3), (1, 4), (4, 5), (5, 6), (5, 6)):  # batches run again, a file comes again
            t.append(spark.read.parquet(f"{landing}/{i}").select("*", at.alias("__position")), epoch)
    results = [sorted(map(str, t.read().collect())) for t in tables]
    assert results[0] == results[1] == results[2]
    assert not any(k == "kind=base" for p in tables[0].live().values() for k, _ in p)
    assert any(k == "kind=base" for p in tables[1].live().values() for k, _ in p)
    assert all(len(p) == 1 for p in tables[2].live().values())
    assert tables[2].vacuum() > 0 and tables[2].vacuum() == 0
    assert sorted(map(str, tables[2].read().collect())) == results[0]
    # an unfinished write is not read
    spark.createDataFrame(batches[0], SYNC).withColumn("at", F.lit(1)).write.parquet(f"{tables[0].path}/kind=delta/epoch=50/month=2020-01")
    assert sorted(map(str, tables[0].read().collect())) == results[0]


def test_dates_of_every_form_are_kept_and_bad_ones_are_not_lost(spark):
    texts = ["2024-01-01T00:00:00", "2024-01-02 10:11:12.345", "2024-01-03", "2024-01", "01/04/2024", "2024/01/05", "2024-01-06T07:08:09Z", None, " "]
    df = spark.createDataFrame([(t, "1", "7.0") for t in texts], "date string, spend string, buCode string")
    rows = L.normalise_raw(df).collect()
    assert sorted(r.date for r in rows) == [D(2024, 1, 1), D(2024, 1, 1), *[D(2024, 1, i) for i in range(2, 7)]]
    assert {r.bu_code for r in rows} == {7}
    stamps = df.where("date like '2024-01-0_ %'").withColumn("date", F.to_timestamp("date"))
    assert [r.date for r in L.normalise_raw(stamps).collect()] == [D(2024, 1, 2)]
    bad = df.unionByName(df.limit(1).withColumn("date", F.lit("soon")))
    with pytest.raises(Exception, match="does not parse"):
        L.normalise_raw(bad).collect()
    assert L.normalise_raw(bad, bad_dates="drop").count() == 7
    assert [r.date for r in L.bad_date_rows(bad).collect()] == ["soon"]


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,accountName,serviceName,spend,bu_code\n2024-01-01,acc,"s ""x""\nline",1.5,\n2024-01-01,acc,t,1,2\n')
    (tmp_path / "b.csv").write_text("serviceName, accountName ,cost,month,bu_code\nt,acc,2,2024-01,1\n")
    rows = {r.service_name: r for r in ingest_csv(spark, str(tmp_path)).collect()}
    assert rows.keys() == {'s "x"\nline', "t"}
    assert rows["t"].spend == Decimal("3.00") and rows["t"].account_name == "acc" and rows["t"].bu_code == 2
    assert read_csv_export(spark, str(tmp_path)).count() == 3
    (tmp_path / "c.csv").write_text("date,spend\n2024-01-01,1,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_csv(spark, str(tmp_path)).collect()


def test_series_with_null_labels_stay(spark):
    schema = "segment string, bu_code int, rmse double, mae double, r2 double, mape double"
    m = spark.createDataFrame([(None, 1, 1.0, 1.0, 0.5, None), ("x", None, 2.0, 2.0, 0.1, 0.5)], schema)
    keys = ["segment", "bu_code"]
    assert MX.model_comparison(m, m, keys).count() == 6
    k = m.select(*keys, F.lit(Decimal("100.00")).cast("decimal(18,2)").alias("total_forecasted_spend"))
    acc = {(r.segment, r.bu_code): r.accuracy_pct for r in MX.dashboard_kpis(k, m, keys).collect()}
    assert acc == {(None, 1): None, ("x", None): 50.0}
    both = null_safe_join(m, m.limit(1).withColumnRenamed("rmse", "q").select(*keys, "q"), keys, "full_outer")
    assert both.count() == 2 and both.columns[:2] == keys


def test_growth_after_an_empty_month_is_null(spark):
    rows = [(D(2024, 1, 1), Decimal(5)), (D(2024, 2, 1), Decimal(0)), (D(2024, 3, 1), Decimal(3))]
    got = P.growth_rate(spark.createDataFrame(rows, "date date, spend decimal(18,2)")).orderBy("month").collect()
    assert [r.growth_rate for r in got] == [-100.0, None]


def test_reconcile_counts_repeats(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "k int, v string")
    got = sorted(tuple(map(str, r)) for r in L.reconcile(a, b).collect())
    assert got == [("1", "None", "left_only"), ("2", "x", "left_only"), ("3", "y", "right_only"), ("3", "y", "right_only")]
