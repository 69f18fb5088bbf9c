"""Invariants on random ledgers."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlake.operators import calendar, ledger as L

ROW = st.tuples(
    st.integers(0, 400),  # day offset
    st.sampled_from(["s1", "s2", "s3"]),
    st.sampled_from(["a1", "a2"]),
    st.decimals(min_value=Decimal("-50"), max_value=Decimal("500"), places=2, allow_nan=False, allow_infinity=False),
    st.one_of(st.none(), st.integers(0, 5)),
)
SCHEMA = "date date, service_name string, account_name string, spend decimal(14,2), bu_code int"
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    base = dt.date(2020, 1, 1)
    return spark.createDataFrame([(base + dt.timedelta(days=d), s, a, v, b) for d, s, a, v, b in rows], SCHEMA)


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=60))
def test_squash_keeps_total_and_unique_keys(spark, rows):
    df = _df(spark, rows)
    sq = L.squash(df, first_cols=("bu_code",))
    assert sq.agg(F.sum("spend")).first()[0] == sum((r[3] for r in rows), Decimal(0))
    assert sq.count() == sq.select(*L.LEDGER_KEY).distinct().count() == len({(r[0], r[1], r[2]) for r in rows})


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=40), st.lists(ROW, min_size=1, max_size=40))
def test_upsert_twice_equals_once(spark, old_rows, new_rows):
    old = L.squash(_df(spark, old_rows), first_cols=("bu_code",))
    new = L.squash(_df(spark, new_rows), first_cols=("bu_code",))
    once = L.upsert(old, new)
    twice = L.upsert(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    # every update key carries the update's spend
    got = {(r["date"], r["service_name"], r["account_name"]): r["spend"] for r in once.collect()}
    for r in new.collect():
        assert got[(r["date"], r["service_name"], r["account_name"])] == r["spend"]


@SETTINGS
@given(st.lists(ROW, min_size=1, max_size=60), st.sampled_from(["day", "month"]))
def test_gap_fill_keeps_sum_and_spans_calendar(spark, rows, gran):
    df = _df(spark, rows)
    out = calendar.resample(df, ["account_name"], gran)
    assert out.agg(F.sum("y")).first()[0] == sum((r[3] for r in rows), Decimal(0))
    base = dt.date(2020, 1, 1)
    for acct in {r[2] for r in rows}:
        days = [base + dt.timedelta(days=r[0]) for r in rows if r[2] == acct]
        lo, hi = min(days), max(days)
        expect = (hi - lo).days + 1 if gran == "day" else (hi.year - lo.year) * 12 + hi.month - lo.month + 1
        assert out.where(F.col("account_name") == acct).count() == expect
