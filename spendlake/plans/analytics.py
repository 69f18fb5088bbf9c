"""Registered analytics queries over the ledger view, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import calendar, ledger as L, profile as P
from ..sources.tables import derive_ledger, ledger
from .sqltext import mean_cents, resample_cte, with_ledger

M = "CAST(date_trunc('month', date) AS DATE)"


def q_ledger_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The ledger view itself (the six-table join every other query reads, once materialised)."""
    return derive_ledger(spark, d)


def q_squash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return L.squash(ledger(spark, d))


def q_resample_monthly(spark: SparkSession, d: str) -> DataFrame:
    return calendar.resample(ledger(spark, d), ["account_name"], "month")


def q_resample_daily_gapfill(spark: SparkSession, d: str) -> DataFrame:
    return calendar.resample(ledger(spark, d), ["bu_code"], "day")


def q_monthly_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.monthly_profile(ledger(spark, d))


def q_spend_range(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_range(ledger(spark, d))


def q_spend_by_account(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_by(ledger(spark, d), "account_name")


def q_spend_by_service(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_by(ledger(spark, d), "service_name")


def q_spend_by_usage_family(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_by(ledger(spark, d), "usage_family")


def q_top_accounts_other(spark: SparkSession, d: str) -> DataFrame:
    return P.top_n_other(ledger(spark, d), "account_name", 10)


def q_top_services_other(spark: SparkSession, d: str) -> DataFrame:
    # the fixture has 6 services; n = 3 so the "Other" path does work
    return P.top_n_other(ledger(spark, d), "service_name", 3)


def q_service_month_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.service_month_cells(ledger(spark, d), 10)


def q_month_top5_services(spark: SparkSession, d: str) -> DataFrame:
    return P.month_top_service_cells(ledger(spark, d), 5)


def q_month_region_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.month_region_cells(ledger(spark, d))


def q_spend_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_percentiles(ledger(spark, d))


def q_mean_ci95(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_ci95(ledger(spark, d))


def q_spend_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.spend_histogram(ledger(spark, d))


def q_box_stats_monthly(spark: SparkSession, d: str) -> DataFrame:
    return P.box_stats_monthly(ledger(spark, d))


def q_density_monthly(spark: SparkSession, d: str) -> DataFrame:
    return P.density_monthly(ledger(spark, d))


def q_cumulative_spend(spark: SparkSession, d: str) -> DataFrame:
    return P.cumulative_spend(ledger(spark, d))


def q_growth_rate(spark: SparkSession, d: str) -> DataFrame:
    return P.growth_rate(ledger(spark, d))


def q_volume_vs_spend(spark: SparkSession, d: str) -> DataFrame:
    return P.volume_vs_spend(ledger(spark, d))


def q_top15_services(spark: SparkSession, d: str) -> DataFrame:
    return P.top_k(ledger(spark, d), "service_name", 15)


def q_top10_accounts(spark: SparkSession, d: str) -> DataFrame:
    return P.top_k(ledger(spark, d), "account_name", 10)


def q_cascading_suggestions(spark: SparkSession, d: str) -> DataFrame:
    # user typing "customer#0000001" in the account box with segment BUILDING active
    return P.cascading_suggestions(ledger(spark, d), "account_name", "customer#0000001", {"segment": "BUILDING", "account_name": "x"})


def q_dimension_filter(spark: SparkSession, d: str) -> DataFrame:
    # service + segment filters active, account / bu_code unset; then the monthly series of the slice
    sl = L.dimension_filter(ledger(spark, d), account_name=None, service_name="STANDARD", bu_code=None, segment_name="AUTOMOBILE")
    return calendar.resample(sl, [], "month")


def q_level_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return P.level_grouping_sets(ledger(spark, d))


def q_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.key_counts(ledger(spark, d))


def q_daily_zoom_last60(spark: SparkSession, d: str) -> DataFrame:
    return P.last_n(calendar.resample(ledger(spark, d), ["bu_code"], "day"), 60, "ds", ["bu_code"])


def q_currency_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.money import currency_text, kpi_currency_text

    m = P.monthly_totals(ledger(spark, d))
    return m.select("month", "total_spend", currency_text("total_spend").alias("axis_label"), kpi_currency_text("total_spend").alias("kpi_label"))


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}


def _resample_sql(key: str, trunc: str, step: str) -> str:
    return with_ledger(f"""
, agg AS (SELECT {key}, CAST(date_trunc('{trunc}', date) AS DATE) AS ds, SUM(spend) AS y FROM ledger GROUP BY 1, 2)
, bounds AS (SELECT {key}, MIN(ds) AS lo, MAX(ds) AS hi FROM agg GROUP BY 1)
, spine AS (SELECT {key}, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {step})) AS DATE) AS ds FROM bounds)
SELECT s.{key}, s.ds, CAST(COALESCE(a.y, 0) AS DECIMAL(18,2)) AS y
FROM spine s LEFT JOIN agg a ON s.{key} = a.{key} AND s.ds = a.ds
""")


def _spend_by_sql(dim: str) -> str:
    return with_ledger(f"SELECT {dim}, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1")


def _top_other_sql(dim: str, n: int) -> str:
    return with_ledger(f"""
, t AS (SELECT {dim} AS k, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1)
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_spend DESC, k ASC NULLS LAST) AS rn FROM t)
SELECT COALESCE(NULLIF(k, ''), 'Uncategorized') AS name, total_spend, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= {n} AND total_spend <> 0
UNION ALL
SELECT 'Other' AS name, CAST(SUM(total_spend) AS DECIMAL(18,2)) AS total_spend, {n + 1} AS rank FROM r WHERE rn > {n} HAVING SUM(total_spend) > 0
""")


def _top_k_sql(dim: str, k: int) -> str:
    return with_ledger(f"""
, t AS (SELECT {dim}, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1)
SELECT * FROM (SELECT {dim}, total_spend, CAST(ROW_NUMBER() OVER (ORDER BY total_spend DESC, {dim} ASC NULLS LAST) AS INTEGER) AS rank FROM t) WHERE rank <= {k}
""")


def _bin_sql(bins: int) -> str:
    # integer arithmetic on cents so values on a bin edge land in the same bin as in Spark
    return (
        f"CAST(LEAST(((CAST(spend * 100 AS BIGINT) - CAST(lo * 100 AS BIGINT)) * {bins}) // "
        f"(CAST(hi * 100 AS BIGINT) - CAST(lo * 100 AS BIGINT)) + 1, {bins}) AS INTEGER)"
    )


ORACLE = {
    "daily_zoom_last60": with_ledger(resample_cte("db", ["bu_code"], "day", "1 DAY") + """
SELECT bu_code, ds, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bu_code ORDER BY ds DESC) AS rn FROM db) WHERE rn <= 60"""),
    "currency_labels": with_ledger(f"""
, m AS (SELECT {M} AS month, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1)
SELECT month, total_spend,
  CASE WHEN total_spend IS NULL OR total_spend = 0 THEN '$0'
       WHEN total_spend >= 1e9 THEN printf('$%.1fB', CAST(total_spend AS DOUBLE) / 1e9)
       WHEN total_spend >= 1e6 THEN printf('$%.1fM', CAST(total_spend AS DOUBLE) / 1e6)
       WHEN total_spend >= 1e3 THEN printf('$%.0fk', CAST(total_spend AS DOUBLE) / 1e3)
       ELSE '$' || CAST(total_spend AS VARCHAR) END AS axis_label,
  CASE WHEN total_spend IS NULL OR total_spend = 0 THEN '$0'
       WHEN total_spend >= 1e6 THEN printf('$%.2fM', CAST(total_spend AS DOUBLE) / 1e6)
       ELSE '$' || format('{{:,.2f}}', CAST(total_spend AS DOUBLE)) END AS kpi_label
FROM m"""),
    "ledger_ingest": with_ledger("SELECT * FROM ledger"),
    "squash_duplicates": with_ledger("""
SELECT date, service_name, account_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend,
       MIN(bu_code) AS bu_code, MIN(segment) AS segment  -- bu_code / segment depend on the account: min = first
FROM ledger GROUP BY 1, 2, 3"""),
    "resample_monthly": _resample_sql("account_name", "month", "1 MONTH"),
    "resample_daily_gapfill": _resample_sql("bu_code", "day", "1 DAY"),
    "monthly_profile": with_ledger(f"""
SELECT {M} AS month, COUNT(spend) AS record_count, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend,
       {mean_cents('spend')} AS avg_spend,
       ROUND(quantile_cont(CAST(spend AS DOUBLE), 0.5), 6) AS median_spend,
       ROUND(stddev_samp(CAST(spend AS DOUBLE)), 4) AS std_spend,
       CAST(MIN(spend) AS DECIMAL(18,2)) AS min_spend, CAST(MAX(spend) AS DECIMAL(18,2)) AS max_spend
FROM ledger GROUP BY 1"""),
    "spend_range": with_ledger("SELECT CAST(MIN(spend) AS DECIMAL(18,2)) AS min_spend, CAST(MAX(spend) AS DECIMAL(18,2)) AS max_spend FROM ledger"),
    "spend_by_account": _spend_by_sql("account_name"),
    "spend_by_service": _spend_by_sql("service_name"),
    "spend_by_usage_family": _spend_by_sql("usage_family"),
    "top_accounts_other": _top_other_sql("account_name", 10),
    "top_services_other": _top_other_sql("service_name", 3),
    "service_month_matrix": with_ledger("""
, t AS (SELECT service_name, SUM(spend) AS tot FROM ledger GROUP BY 1)
, top AS (SELECT service_name FROM t ORDER BY tot DESC, service_name LIMIT 10)
, months AS (SELECT DISTINCT strftime(date, '%Y-%m') AS m FROM ledger)
, cells AS (
    SELECT service_name, strftime(date, '%Y-%m') AS m, spend FROM ledger WHERE service_name IN (SELECT service_name FROM top)
    UNION ALL SELECT top.service_name, months.m, NULL FROM top, months)
SELECT service_name AS "row", m AS col, CAST(COALESCE(SUM(spend), 0) AS DECIMAL(18,2)) AS spend FROM cells GROUP BY 1, 2"""),
    "month_top5_services": with_ledger(f"""
, t AS (SELECT service_name, SUM(spend) AS tot FROM ledger GROUP BY 1)
, top AS (SELECT service_name FROM t ORDER BY tot DESC, service_name LIMIT 5)
, cells AS (SELECT {M} AS month, service_name, spend FROM ledger WHERE service_name IN (SELECT service_name FROM top))
, grid AS (SELECT * FROM cells UNION ALL SELECT m.month, s.service_name, 0 FROM (SELECT DISTINCT month FROM cells) m, (SELECT DISTINCT service_name FROM cells) s)
SELECT month AS "row", service_name AS col, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend FROM grid GROUP BY 1, 2"""),
    "month_region_matrix": with_ledger(f"""
, cells AS (SELECT {M} AS month, region, spend FROM ledger)
, grid AS (SELECT * FROM cells UNION ALL SELECT m.month, s.region, 0 FROM (SELECT DISTINCT month FROM cells) m, (SELECT DISTINCT region FROM cells) s)
SELECT month AS "row", region AS col, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend FROM grid GROUP BY 1, 2"""),
    "spend_percentiles": with_ledger("""
, q AS (SELECT quantile_cont(CAST(spend AS DOUBLE), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS v FROM ledger)
SELECT CAST(p AS INTEGER) AS percentile, ROUND(v[i], 6) AS spend_value
FROM q, (SELECT UNNEST([10, 25, 50, 75, 90, 95, 99]) AS p, UNNEST(range(1, 8)) AS i)"""),
    "mean_ci95": with_ledger(f"""
, s AS (SELECT {M} AS month, {mean_cents('spend')} AS mean_spend, stddev_samp(CAST(spend AS DOUBLE)) AS std, COUNT(spend) AS n FROM ledger GROUP BY 1)
SELECT month, mean_spend, n, ROUND(std, 4) AS std_spend, ROUND(std / sqrt(n), 4) AS se, ROUND(1.96 * std / sqrt(n), 4) AS ci_95,
       ROUND(CAST(mean_spend AS DOUBLE) - 1.96 * std / sqrt(n), 4) AS lower, ROUND(CAST(mean_spend AS DOUBLE) + 1.96 * std / sqrt(n), 4) AS upper
FROM s"""),
    "spend_histogram": with_ledger(f"""
, b AS (SELECT MIN(spend) AS lo, MAX(spend) AS hi FROM ledger)
, h AS (SELECT {_bin_sql(50)} AS bin, COUNT(*) AS n FROM ledger, b GROUP BY 1)
SELECT bin, ROUND(CAST(lo AS DOUBLE) + (bin - 1) * ((CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) / 50), 4) AS bin_lo,
       ROUND(CAST(lo AS DOUBLE) + bin * ((CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) / 50), 4) AS bin_hi, n
FROM h, b"""),
    "box_stats_monthly": with_ledger(f"""
, base AS (SELECT {M} AS month, CAST(spend AS DOUBLE) AS v FROM ledger)
, q0 AS (SELECT month, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM base GROUP BY 1)
, q1 AS (SELECT month, ROUND(q[1], 6) AS q1, ROUND(q[2], 6) AS median, ROUND(q[3], 6) AS q3 FROM q0)
, q2 AS (SELECT *, ROUND(q3 - q1, 6) AS iqr FROM q1)
, q AS (SELECT *, ROUND(q1 - 1.5 * iqr, 6) AS lower_fence, ROUND(q3 + 1.5 * iqr, 6) AS upper_fence FROM q2)
SELECT q.*, MIN(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END) AS whisker_low,
       MAX(CASE WHEN v >= lower_fence AND v <= upper_fence THEN v END) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (v >= lower_fence AND v <= upper_fence)) AS n_outliers
FROM base JOIN q USING (month) GROUP BY ALL"""),
    "density_monthly": with_ledger(f"""
, b AS (SELECT MIN(spend) AS lo, MAX(spend) AS hi FROM ledger)
, h AS (SELECT {M} AS month, {_bin_sql(20)} AS bin, COUNT(*) AS n FROM ledger, b GROUP BY 1, 2)
SELECT month, bin, n, ROUND(n / SUM(n) OVER (PARTITION BY month), 6) AS density FROM h"""),
    "cumulative_spend": with_ledger(f"""
, m AS (SELECT {M} AS month, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1)
SELECT month, total_spend, CAST(SUM(total_spend) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS cumulative_spend FROM m"""),
    "growth_rate": with_ledger(f"""
, m AS (SELECT {M} AS month, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend FROM ledger GROUP BY 1)
, g AS (SELECT month, total_spend, LAG(total_spend) OVER (ORDER BY month) AS prev FROM m)
SELECT month, total_spend, ROUND(CAST((CAST(total_spend AS DECIMAL(38,10)) / prev - 1) * 100 AS DOUBLE), 6) AS growth_rate FROM g WHERE prev IS NOT NULL"""),
    "volume_vs_spend": with_ledger(f"""
, m AS (SELECT {M} AS month, COUNT(spend) AS record_count, CAST(SUM(spend) AS DECIMAL(18,2)) AS total_spend, {mean_cents('spend')} AS avg_spend FROM ledger GROUP BY 1)
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY month) - 1 AS INTEGER) AS month_index FROM m"""),
    "top15_services": _top_k_sql("service_name", 15),
    "top10_accounts": _top_k_sql("account_name", 10),
    "cascading_suggestions": with_ledger("""
SELECT DISTINCT CAST(account_name AS VARCHAR) AS suggestion FROM ledger
WHERE segment = 'BUILDING' AND lower(account_name) LIKE '%customer#0000001%' AND account_name IS NOT NULL
ORDER BY 1 LIMIT 10"""),
    "dimension_filter": with_ledger("""
, agg AS (SELECT CAST(date_trunc('month', date) AS DATE) AS ds, SUM(spend) AS y FROM ledger
          WHERE service_name = 'STANDARD' AND segment = 'AUTOMOBILE' GROUP BY 1)
, spine AS (SELECT CAST(UNNEST(generate_series(CAST(MIN(ds) AS TIMESTAMP), CAST(MAX(ds) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ds FROM agg)
SELECT s.ds, CAST(COALESCE(a.y, 0) AS DECIMAL(18,2)) AS y FROM spine s LEFT JOIN agg a USING (ds)"""),
    "level_grouping_sets": with_ledger(f"""
, b AS (SELECT {M} AS month, account_name, service_name, CAST(bu_code AS VARCHAR) AS bu_code, segment, spend FROM ledger)
, g AS (SELECT month, account_name, service_name, bu_code, segment,
           GROUPING(account_name, service_name, bu_code, segment) AS gid, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend
        FROM b GROUP BY GROUPING SETS ((month), (month, account_name), (month, service_name), (month, bu_code), (month, segment)))
SELECT CASE gid WHEN 15 THEN 'overall' WHEN 7 THEN 'account_name' WHEN 11 THEN 'service_name' WHEN 13 THEN 'bu_code' ELSE 'segment' END AS level,
       CASE gid WHEN 7 THEN account_name WHEN 11 THEN service_name WHEN 13 THEN bu_code WHEN 14 THEN segment END AS level_key,
       month, spend FROM g"""),
    "key_counts": with_ledger("""
SELECT COUNT(*) AS rows, COUNT(DISTINCT account_name) AS distinct_account_name, COUNT(DISTINCT service_name) AS distinct_service_name FROM ledger"""),
}
