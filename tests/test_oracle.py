"""Every registered query against its DuckDB oracle at sf0.001 (rows-only where there is none)."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from oracle_check import rows_of  # noqa: E402

from spendlake.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in sorted(p[:-8] for p in os.listdir(SF) if p.endswith(".parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# queries of the training-data subpackage have their own tests beside it
OWN = set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & OWN))
def test_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert Counter(rows_of(sdf.columns, srows)) == Counter(rows_of(dcols, drows))


@pytest.mark.parametrize("name", sorted(OWN - set(oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) > 0
    # a forecast is a number wherever there is one
    for c in {"yhat", "prediction", "rmse", "mean_rmse"} & set(df.columns):
        assert all(r[c] is None or float(r[c]) == float(r[c]) for r in rows) and any(r[c] is not None for r in rows)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "total_spend" in df.columns
