"""Provider billing payloads landed as files, flattened to ledger rows.

The reference pulls these over the network one request at a time; here they are landed exports
(JSON text per page, or nested rows) and the flattening is a projection: ``from_json`` with a fixed
schema, ``explode`` per nesting level, ``getItem`` / dotted access, and a typed cast. Every page is
an independent row, so pages spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MONEY, RAW_MONEY

# Provider payload schemas.
AWS_SCHEMA = (
    "ResultsByTime ARRAY<STRUCT<TimePeriod: STRUCT<Start: STRING, End: STRING>, "
    "Groups: ARRAY<STRUCT<Keys: ARRAY<STRING>, Metrics: STRUCT<UnblendedCost: STRUCT<Amount: STRING, Unit: STRING>>>>>>"
)
AZURE_SCHEMA = "rows ARRAY<ARRAY<STRING>>"  # [cost, usage date yyyyMMdd, service, subscription]
GCP_SCHEMA = (
    "usage_start_time TIMESTAMP, service STRUCT<description: STRING>, project STRUCT<name: STRING>, "
    "cost DECIMAL(20,6), credits ARRAY<STRUCT<amount: DECIMAL(20,6)>>"
)


def flatten_aws(pages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``ResultsByTime[] -> Groups[] -> (date, service = Keys[0], account = Keys[1], cost)``."""
    p = pages.select(F.from_json(F.col(payload_col), AWS_SCHEMA).alias("p"))
    r = p.select(F.explode("p.ResultsByTime").alias("r"))
    g = r.select(F.col("r.TimePeriod.Start").alias("start"), F.explode("r.Groups").alias("g"))
    return g.select(
        F.to_date("start").alias("date"),
        F.col("g.Keys").getItem(0).alias("service_name"),
        F.col("g.Keys").getItem(1).alias("account_name"),
        F.col("g.Metrics.UnblendedCost.Amount").try_cast(RAW_MONEY).alias("spend"),
    )


def flatten_azure(pages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Usage rows are positional lists: cost, usage date, service, subscription."""
    p = pages.select(F.from_json(F.col(payload_col), AZURE_SCHEMA).alias("p"))
    r = p.select(F.explode("p.rows").alias("r"))
    return r.select(
        F.to_date(F.col("r").getItem(1), "yyyyMMdd").alias("date"),
        F.col("r").getItem(2).alias("service_name"),
        F.col("r").getItem(3).alias("account_name"),
        F.col("r").getItem(0).try_cast(RAW_MONEY).alias("spend"),
    )


def credit_total(credits: Column) -> Column:
    """Null-safe sum of ``credits[].amount`` (null or empty list -> 0)."""
    zero = F.lit(0).cast(RAW_MONEY)
    return F.coalesce(F.aggregate(credits, zero, lambda acc, c: (acc + F.coalesce(c["amount"], zero)).cast(RAW_MONEY)), zero)


def gcp_daily_costs(export: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """Per (day, service.description, project.name): sum(cost) + sum(credits), for days in
    [start_date, end_date] (both inclusive). The date predicate is written on the raw timestamp
    so it reaches the scan as a pushed filter."""
    lo = F.to_timestamp(F.lit(start_date))
    hi = F.to_timestamp(F.date_add(F.to_date(F.lit(end_date)), 1))
    rows = export.where((F.col("usage_start_time") >= lo) & (F.col("usage_start_time") < hi))
    return rows.groupBy(
        F.to_date("usage_start_time").alias("date"),
        F.col("service.description").alias("service_name"),
        F.col("project.name").alias("account_name"),
    ).agg((F.sum("cost") + F.sum(credit_total(F.col("credits")))).cast(MONEY).alias("spend"))


# ----------------------------------------------------------------------------- packing (fixtures)
def with_pages(ledger_rows: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """Rows with the payload page they go to: a day has as many pages as its row count asks for, so a
    payload's size does not follow the data. Rows are dealt to pages by hash."""
    days = ledger_rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / page_rows).alias("__pages"))
    page = F.pmod(F.xxhash64("account_name", "service_name"), F.col("__pages"))
    return ledger_rows.join(days, "date").withColumn("page", page).drop("__pages")


def pack_aws(ledger_rows: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """Ledger rows (date, service_name, account_name, spend) -> one AWS-style JSON payload per
    (day, page). Used to build landed test payloads from the driver tables."""
    grp = F.struct(
        F.array("service_name", "account_name").alias("Keys"),
        F.struct(F.struct(F.col("spend").cast("string").alias("Amount"), F.lit("USD").alias("Unit")).alias("UnblendedCost")).alias("Metrics"),
    )
    per_page = with_pages(ledger_rows, page_rows).groupBy("date", "page").agg(F.collect_list(grp).alias("Groups"))
    result = F.struct(
        F.struct(F.date_format("date", "yyyy-MM-dd").alias("Start"), F.date_format(F.date_add("date", 1), "yyyy-MM-dd").alias("End")).alias("TimePeriod"),
        F.col("Groups"),
    )
    return per_page.select(F.to_json(F.struct(F.array(result).alias("ResultsByTime"))).alias("payload"))


def pack_azure(ledger_rows: DataFrame, page_rows: int = 1_000) -> DataFrame:
    row = F.array(F.col("spend").cast("string"), F.date_format("date", "yyyyMMdd"), F.col("service_name"), F.col("account_name"))
    per_page = with_pages(ledger_rows, page_rows).groupBy("date", "page").agg(F.collect_list(row).alias("rows"))
    return per_page.select(F.to_json(F.struct("rows")).alias("payload"))
