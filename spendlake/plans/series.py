"""Registered series-feature, forecasting and reporting queries with their DuckDB oracles.

Series used (all derived from the ledger view):
* squashed ledger rows, keyed (account_name, service_name), one row per date
* monthly per (segment, service_name): 30 series, the forecasting panel
* monthly per account_name: 1,500 series with gaps
* daily per bu_code: 25 series with gaps
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import linear
from ..operators import calendar, features as FT, ledger as L, metrics as MX
from ..sources.tables import ledger
from .sqltext import div_exact, mean_cents, ols_sql, resample_cte, with_ledger

PANEL = ["segment", "service_name"]
H = 24


def panel(spark: SparkSession, d: str) -> DataFrame:
    return calendar.resample(ledger(spark, d), PANEL, "month")


def by_account(spark: SparkSession, d: str) -> DataFrame:
    return calendar.resample(ledger(spark, d), ["account_name"], "month")


def daily_bu(spark: SparkSession, d: str) -> DataFrame:
    return calendar.resample(ledger(spark, d), ["bu_code"], "day")


def insample_preds(spark: SparkSession, d: str) -> DataFrame:
    """Panel rows with two in-sample baselines: the previous period and one season back."""
    p = panel(spark, d)
    p = FT.add_lags(p, PANEL, ["ds"], "y", [1, 12], prefix="pred_lag")
    return p


def q_group_lags(spark: SparkSession, d: str) -> DataFrame:
    sq = L.squash(ledger(spark, d)).select("date", "account_name", "service_name", "spend")
    return FT.add_lags(sq, ["account_name", "service_name"], ["date"], "spend")


def q_rolling_means(spark: SparkSession, d: str) -> DataFrame:
    sq = L.squash(ledger(spark, d)).select("date", "account_name", "service_name", "spend")
    return FT.add_rolling_means(sq, ["account_name", "service_name"], ["date"], "spend")


def q_series_lags(spark: SparkSession, d: str) -> DataFrame:
    return FT.add_lags(panel(spark, d), PANEL, ["ds"], "y", [1, 2, 3]).na.drop(subset=["lag_1", "lag_2", "lag_3"])


def q_calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return FT.add_calendar(daily_bu(spark, d))


def q_tail_features(spark: SparkSession, d: str) -> DataFrame:
    return FT.tail_features(by_account(spark, d), ["account_name"])


def q_split_80_20(spark: SparkSession, d: str) -> DataFrame:
    return FT.chronological_split(panel(spark, d), PANEL, train_frac=0.8)


def q_split_85_15(spark: SparkSession, d: str) -> DataFrame:
    lagged = FT.add_lags(panel(spark, d), PANEL, ["ds"], "y", [1, 2, 3]).na.drop(subset=["lag_1", "lag_2", "lag_3"])
    return FT.chronological_split(lagged, PANEL, train_frac=0.85)


def q_ts_folds(spark: SparkSession, d: str) -> DataFrame:
    return FT.expanding_folds(panel(spark, d), PANEL)


def q_backtest_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return FT.backtest_cutoffs(daily_bu(spark, d), ["bu_code"])


def q_future_calendar(spark: SparkSession, d: str) -> DataFrame:
    return calendar.future_calendar(by_account(spark, d), ["account_name"], H, "month")


def q_ols_trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    return linear.ols_trend(panel(spark, d), PANEL, H)


def q_seasonal_naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return linear.seasonal_naive(panel(spark, d), PANEL, H)


def q_ar_recursive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return linear.ar1_recursive(panel(spark, d), PANEL, 12)


def q_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return MX.error_metrics(insample_preds(spark, d), PANEL, "y", "pred_lag12")


def q_forecast_kpis(spark: SparkSession, d: str) -> DataFrame:
    return MX.forecast_kpis(linear.ols_trend(panel(spark, d), PANEL, H), PANEL)


def q_dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    k = MX.forecast_kpis(linear.ols_trend(panel(spark, d), PANEL, H), PANEL)
    m = MX.error_metrics(insample_preds(spark, d), PANEL, "y", "pred_lag12")
    return MX.dashboard_kpis(k, m, PANEL)


def q_model_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = insample_preds(spark, d).where(F.col("pred_lag12").isNotNull())
    a = MX.error_metrics(p, PANEL, "y", "pred_lag12")
    b = MX.error_metrics(p, PANEL, "y", "pred_lag1")
    return MX.model_comparison(a, b, PANEL, "seasonal", "previous")


def q_forecast_difference(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d)
    return MX.forecast_difference(linear.ols_trend(s, PANEL, H), linear.seasonal_naive(s, PANEL, H), PANEL)


def q_forecast_difference_summary(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d)
    diff = MX.forecast_difference(linear.ols_trend(s, PANEL, H), linear.seasonal_naive(s, PANEL, H), PANEL)
    return MX.forecast_difference_summary(diff, PANEL)


def q_history_forecast_align(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d)
    f = MX.output_adapter(linear.ols_trend(s, PANEL, H))
    return MX.align_history_forecast(s, f, PANEL)


def q_variance_facts(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d)
    return MX.variance_facts(s, linear.ols_trend(s, PANEL, H), PANEL)


def q_actual_vs_predicted(spark: SparkSession, d: str) -> DataFrame:
    return MX.actual_vs_predicted_monthly(insample_preds(spark, d).where(F.col("pred_lag12").isNotNull()), "ds", "y", ["pred_lag1", "pred_lag12"])


def q_result_filter(spark: SparkSession, d: str) -> DataFrame:
    """Dashboard filters on a result frame; ``account_name`` is not a column of the panel
    forecast and is skipped, the others apply; NaN doubles read null."""
    f = linear.ols_trend(panel(spark, d), PANEL, H).withColumn("yhat", F.when(F.month("ds") == 1, F.lit(float("nan"))).otherwise(F.col("yhat")))
    return L.result_filter(f, {"segment": "BUILDING", "account_name": "Customer#000000001", "service_name": None})


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}

# ----------------------------------------------------------------------------- oracles
PANEL_CTE = resample_cte("ms", PANEL)
ACCT_CTE = resample_cte("ma", ["account_name"])
DAILY_CTE = resample_cte("db", ["bu_code"], "day", "1 DAY")
SQ_CTE = """
, sq AS (SELECT date, account_name, service_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend FROM ledger GROUP BY 1, 2, 3)"""
MI = "(year(ds) * 12 + month(ds) - 1)"
W_PANEL = "PARTITION BY segment, service_name ORDER BY ds"

OLS_CTE = ols_sql("ols", "ms", PANEL, H)
SNAIVE_CTE = f"""
, lastv AS (SELECT segment, service_name, MAX(ds) AS last_ds, arg_max(y, ds) AS last_y FROM ms GROUP BY 1, 2)
, fut AS (SELECT segment, service_name, last_y, CAST(last_ds + INTERVAL (h) MONTH AS DATE) AS ds,
                 CAST(last_ds + INTERVAL (h - 12 * CAST(ceil(h / 12.0) AS INTEGER)) MONTH AS DATE) AS src_ds
          FROM lastv, (SELECT UNNEST(range(1, {H + 1})) AS h))
, snaive AS (SELECT f.segment, f.service_name, f.ds, CAST(COALESCE(m.y, f.last_y) AS DECIMAL(18,2)) AS yhat
             FROM fut f LEFT JOIN ms m ON m.segment = f.segment AND m.service_name = f.service_name AND m.ds = f.src_ds)"""
PREDS_CTE = f"""
, pr AS (SELECT *, LAG(y, 1) OVER ({W_PANEL}) AS pred_lag1, LAG(y, 12) OVER ({W_PANEL}) AS pred_lag12 FROM ms)"""


def _metrics_sql(src: str, pred: str, where: str = "") -> str:
    cond = f"y IS NOT NULL AND {pred} IS NOT NULL" + (f" AND {where}" if where else "")
    e = f"(CAST(y AS DECIMAL(20,2)) - CAST({pred} AS DECIMAL(20,2)))"
    mse = div_exact(f"SUM({e} * {e})", "COUNT(*)", 6, 4, 38)
    mae = div_exact(f"SUM(abs({e}))", "COUNT(*)", 6, 2, 38)
    return f"""(SELECT segment, service_name, COUNT(*) AS n, {mse} AS mse, {mae} AS mae,
       ROUND(sqrt(CAST({mse} AS DOUBLE)), 4) AS rmse,
       ROUND(AVG(CASE WHEN CAST(y AS DOUBLE) <> 0 THEN abs(CAST(y AS DOUBLE) - CAST({pred} AS DOUBLE)) / abs(CAST(y AS DOUBLE)) END), 6) AS mape,
       ROUND(CASE WHEN var_pop(CAST(y AS DOUBLE)) > 0 THEN 1 - CAST(SUM({e} * {e}) AS DOUBLE) / (var_pop(CAST(y AS DOUBLE)) * COUNT(*)) END, 6) AS r2
FROM {src} WHERE {cond} GROUP BY 1, 2)"""


KPI_SQL = f"""(SELECT segment, service_name, CAST(SUM(CAST(yhat AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_forecasted_spend,
       {mean_cents("CAST(yhat AS DECIMAL(18,2))")} AS average_monthly_spend, COUNT(*) AS forecast_period FROM ols GROUP BY 1, 2)"""

ORACLE = {
    "result_filter": with_ledger(PANEL_CTE + OLS_CTE + """
SELECT segment, service_name, ds, CASE WHEN month(ds) = 1 THEN NULL ELSE yhat END AS yhat FROM ols WHERE segment = 'BUILDING'"""),
    "group_lags": with_ledger(SQ_CTE + """
SELECT date, account_name, service_name, spend,
  LAG(spend, 1) OVER w AS lag_1, LAG(spend, 2) OVER w AS lag_2, LAG(spend, 3) OVER w AS lag_3,
  LAG(spend, 6) OVER w AS lag_6, LAG(spend, 12) OVER w AS lag_12
FROM sq WINDOW w AS (PARTITION BY account_name, service_name ORDER BY date)"""),
    "rolling_means": with_ledger(SQ_CTE + f"""
SELECT date, account_name, service_name, spend,
  CASE WHEN COUNT(spend) OVER w3 = 3 THEN {div_exact('SUM(spend) OVER w3', '3')} END AS rolling_mean_3,
  CASE WHEN COUNT(spend) OVER w6 = 6 THEN {div_exact('SUM(spend) OVER w6', '6')} END AS rolling_mean_6
FROM sq WINDOW w3 AS (PARTITION BY account_name, service_name ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
              w6 AS (PARTITION BY account_name, service_name ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""),
    "series_lags": with_ledger(PANEL_CTE + f"""
SELECT * FROM (SELECT *, LAG(y, 1) OVER ({W_PANEL}) AS lag_1, LAG(y, 2) OVER ({W_PANEL}) AS lag_2, LAG(y, 3) OVER ({W_PANEL}) AS lag_3 FROM ms)
WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL"""),
    "calendar_features": with_ledger(DAILY_CTE + """
SELECT bu_code, ds, y, year(ds) AS year, month(ds) AS month, day(ds) AS day, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek,
       quarter(ds) AS quarter, CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM db"""),
    "tail_features": with_ledger(ACCT_CTE + f"""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_name ORDER BY ds DESC) AS rn FROM ma)
, t AS (SELECT account_name, COUNT(*) AS n_periods, MAX(CASE WHEN rn = 1 THEN y END) AS last,
          MAX(CASE WHEN rn = 2 THEN y END) AS l2, MAX(CASE WHEN rn = 3 THEN y END) AS l3, MAX(CASE WHEN rn = 6 THEN y END) AS l6,
          MAX(CASE WHEN rn = 12 THEN y END) AS l12, SUM(CASE WHEN rn <= 3 THEN y END) AS s3, SUM(CASE WHEN rn <= 6 THEN y END) AS s6
        FROM r GROUP BY 1)
SELECT account_name, n_periods, last AS lag_1, COALESCE(l2, last) AS lag_2, COALESCE(l3, last) AS lag_3, COALESCE(l6, last) AS lag_6,
       COALESCE(l12, last) AS lag_12,
       CASE WHEN n_periods >= 3 THEN {div_exact('s3', '3')} ELSE CAST(last AS DECIMAL(18,4)) END AS rolling_mean_3,
       CASE WHEN n_periods >= 6 THEN {div_exact('s6', '6')} ELSE CAST(last AS DECIMAL(18,4)) END AS rolling_mean_6
FROM t"""),
    "split_80_20": with_ledger(PANEL_CTE + f"""
SELECT segment, service_name, ds, y, rn, rn <= floor(n * CAST(0.8 AS DOUBLE)) AS is_train FROM (
  SELECT segment, service_name, ds, y, CAST(ROW_NUMBER() OVER ({W_PANEL}) AS INTEGER) AS rn,
         COUNT(*) OVER (PARTITION BY segment, service_name) AS n FROM ms)"""),
    "split_85_15": with_ledger(PANEL_CTE + f"""
, lg AS (SELECT * FROM (SELECT *, LAG(y, 1) OVER ({W_PANEL}) AS lag_1, LAG(y, 2) OVER ({W_PANEL}) AS lag_2, LAG(y, 3) OVER ({W_PANEL}) AS lag_3 FROM ms)
         WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL)
SELECT segment, service_name, ds, y, lag_1, lag_2, lag_3, rn, rn <= floor(n * CAST(0.85 AS DOUBLE)) AS is_train FROM (
  SELECT *, CAST(ROW_NUMBER() OVER ({W_PANEL}) AS INTEGER) AS rn, COUNT(*) OVER (PARTITION BY segment, service_name) AS n FROM lg)"""),
    "ts_folds": with_ledger(PANEL_CTE + f"""
, b AS (SELECT *, ROW_NUMBER() OVER ({W_PANEL}) - 1 AS pos, COUNT(*) OVER (PARTITION BY segment, service_name) AS n FROM ms)
, f AS (SELECT b.*, fold, n // 4 AS t, n - (3 - fold) * (n // 4) AS st FROM b, (SELECT UNNEST([0, 1, 2]) AS fold))
SELECT segment, service_name, ds, y, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < st THEN 'train' ELSE 'val' END AS role
FROM f WHERE t > 0 AND pos < st + t"""),
    "backtest_cutoffs": with_ledger(DAILY_CTE + """
, b AS (SELECT bu_code, MIN(ds) AS lo, MAX(ds) AS hi FROM db GROUP BY 1)
SELECT bu_code, CAST(UNNEST(generate_series(CAST(hi - INTERVAL 90 DAY AS TIMESTAMP), CAST(lo + INTERVAL 180 DAY AS TIMESTAMP), -INTERVAL 30 DAY)) AS DATE) AS cutoff
FROM b WHERE hi - INTERVAL 90 DAY >= lo + INTERVAL 180 DAY"""),
    "future_calendar": with_ledger(ACCT_CTE + f"""
, l AS (SELECT account_name, MAX(ds) AS last FROM ma GROUP BY 1)
SELECT account_name, CAST(h AS INTEGER) AS h, CAST(last + INTERVAL (h) MONTH AS DATE) AS ds FROM l, (SELECT UNNEST(range(1, {H + 1})) AS h)"""),
    "ols_trend_forecast": with_ledger(PANEL_CTE + OLS_CTE + "\nSELECT * FROM ols"),
    "seasonal_naive_forecast": with_ledger(PANEL_CTE + SNAIVE_CTE + "\nSELECT * FROM snaive"),
    "ar_recursive_forecast": "WITH RECURSIVE" + with_ledger(PANEL_CTE + f"""
, lg AS (SELECT *, LAG(CAST(y AS DOUBLE)) OVER ({W_PANEL}) AS prev FROM ms)
, fit AS (SELECT segment, service_name, regr_intercept(CAST(y AS DOUBLE), prev) AS a0, regr_slope(CAST(y AS DOUBLE), prev) AS b0,
                 MAX(ds) AS last_ds, arg_max(CAST(y AS DOUBLE), ds) AS last_y FROM lg GROUP BY 1, 2)
, p AS (SELECT segment, service_name, last_ds, last_y, CASE WHEN b0 IS NULL THEN 0.0 ELSE COALESCE(a0, 0.0) END AS a, COALESCE(b0, 1.0) AS b FROM fit)
, rec AS (
    SELECT segment, service_name, last_ds, a, b, 1 AS h, greatest(a + b * last_y, 0.0) AS v FROM p
    UNION ALL
    SELECT segment, service_name, last_ds, a, b, h + 1, greatest(a + b * v, 0.0) FROM rec WHERE h < 12)
SELECT segment, service_name, CAST(last_ds + INTERVAL (h) MONTH AS DATE) AS ds, ROUND(v, 2) AS yhat FROM rec""")[len("WITH"):],
    "error_metrics": with_ledger(PANEL_CTE + PREDS_CTE + "\nSELECT * FROM " + _metrics_sql("pr", "pred_lag12")),
    "forecast_kpis": with_ledger(PANEL_CTE + OLS_CTE + "\nSELECT * FROM " + KPI_SQL),
    "dashboard_kpis": with_ledger(PANEL_CTE + OLS_CTE + PREDS_CTE + f"""
, k AS {KPI_SQL}
, m AS {_metrics_sql("pr", "pred_lag12")}
, j AS (SELECT k.segment, k.service_name, COALESCE(CAST(total_forecasted_spend AS DOUBLE), 0.0) AS total, m.mape FROM k LEFT JOIN m USING (segment, service_name))
, v AS (SELECT *, total * 1.2 AS budget, CASE WHEN total * 1.2 > 0 THEN total / (total * 1.2) * 100 ELSE 0.0 END AS pct,
               greatest(0.0, 100.0 - COALESCE(mape, 0.0) * 100) AS acc FROM j)
SELECT segment, service_name, ROUND(budget, 2) AS budget, ROUND(pct, 4) AS spend_pct, CAST(floor(pct / 100 * 8) AS INTEGER) AS spend_segments,
       ROUND(acc, 4) AS accuracy_pct, CAST(floor(acc / 100 * 8) AS INTEGER) AS accuracy_segments FROM v"""),
    "model_comparison": with_ledger(PANEL_CTE + PREDS_CTE + f"""
, a AS {_metrics_sql("pr", "pred_lag12")}
, b AS {_metrics_sql("pr", "pred_lag1", "pred_lag12 IS NOT NULL")}
, j AS (SELECT a.segment, a.service_name, a.rmse AS a_rmse, CAST(a.mae AS DOUBLE) AS a_mae, a.r2 AS a_r2, b.rmse AS b_rmse, CAST(b.mae AS DOUBLE) AS b_mae, b.r2 AS b_r2
        FROM a JOIN b USING (segment, service_name))
, l AS (SELECT segment, service_name, 'rmse' AS metric, a_rmse AS value_a, b_rmse AS value_b FROM j
        UNION ALL SELECT segment, service_name, 'mae', a_mae, b_mae FROM j
        UNION ALL SELECT segment, service_name, 'r2', a_r2, b_r2 FROM j)
SELECT *, CASE WHEN (CASE WHEN metric = 'r2' THEN value_a > value_b ELSE value_a < value_b END) THEN 'seasonal' ELSE 'previous' END AS winner FROM l"""),
    "forecast_difference": with_ledger(PANEL_CTE + OLS_CTE + SNAIVE_CTE + """
SELECT o.segment, o.service_name, o.ds, CAST(o.yhat AS DOUBLE) AS yhat_a, CAST(s.yhat AS DOUBLE) AS yhat_b,
       ROUND(CAST(o.yhat AS DOUBLE) - CAST(s.yhat AS DOUBLE), 4) AS diff,
       ROUND(COALESCE((CAST(o.yhat AS DOUBLE) - CAST(s.yhat AS DOUBLE)) * 100 / NULLIF(CAST(s.yhat AS DOUBLE), 0), 0.0), 4) AS pct_diff
FROM ols o JOIN snaive s USING (segment, service_name, ds)"""),
    "forecast_difference_summary": with_ledger(PANEL_CTE + OLS_CTE + SNAIVE_CTE + f"""
, j AS (SELECT o.segment, o.service_name, CAST(o.yhat AS DOUBLE) AS a, CAST(s.yhat AS DOUBLE) AS b FROM ols o JOIN snaive s USING (segment, service_name, ds))
SELECT segment, service_name, {mean_cents("CAST(a AS DECIMAL(18,2))")} AS avg_a, {mean_cents("CAST(b AS DECIMAL(18,2))")} AS avg_b,
       {mean_cents("(CAST(a AS DECIMAL(18,2)) - CAST(b AS DECIMAL(18,2)))")} AS avg_diff,
       ROUND(AVG((a - b) / NULLIF(b, 0)) * 100, 4) AS avg_pct_diff, MIN(a) AS min_a, MAX(a) AS max_a, MIN(b) AS min_b, MAX(b) AS max_b
FROM j GROUP BY 1, 2"""),
    "history_forecast_align": with_ledger(PANEL_CTE + OLS_CTE + """
, f AS (SELECT segment, service_name, ds, yhat AS predicted,
               CASE WHEN COALESCE(yhat, 0) <> 0 THEN yhat * 0.9 ELSE 0.0 END AS lo,
               CASE WHEN COALESCE(yhat, 0) <> 0 THEN yhat * 1.1 ELSE 0.0 END AS hi
        FROM ols WHERE ds IS NOT NULL AND COALESCE(yhat, 0) <> 0)
, h AS (SELECT segment, service_name, ds, COALESCE(CAST(y AS DOUBLE), 0.0) AS actual, TRUE AS hh FROM ms WHERE ds IS NOT NULL)
SELECT COALESCE(h.segment, f.segment) AS segment, COALESCE(h.service_name, f.service_name) AS service_name, COALESCE(h.ds, f.ds) AS ds,
       h.actual, f.predicted,
       CASE WHEN h.hh IS NULL AND COALESCE(f.lo, 0) <> 0 THEN f.lo END AS band_lower,
       CASE WHEN h.hh IS NULL AND COALESCE(f.lo, 0) <> 0 THEN f.hi END AS band_upper
FROM h FULL OUTER JOIN f ON h.segment = f.segment AND h.service_name = f.service_name AND h.ds = f.ds"""),
    "variance_facts": with_ledger(PANEL_CTE + OLS_CTE + """
, h AS (SELECT segment, service_name, CAST(SUM(y) AS DECIMAL(18,2)) AS historical_total, COUNT(DISTINCT date_trunc('month', ds)) AS historical_months FROM ms GROUP BY 1, 2)
, f AS (SELECT segment, service_name, CAST(SUM(CAST(yhat AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS forecast_total, COUNT(*) AS forecast_periods FROM ols GROUP BY 1, 2)
SELECT segment, service_name, historical_total, forecast_total, CAST(forecast_total - historical_total AS DECIMAL(18,2)) AS variance,
       CASE WHEN forecast_total - historical_total > 0 THEN 'an increase of $' ELSE 'a decrease of $' END
         || format('{:,.2f}', CAST(abs(forecast_total - historical_total) AS DOUBLE)) AS trend,
       historical_months, forecast_periods
FROM h JOIN f USING (segment, service_name)"""),
    "actual_vs_predicted": with_ledger(PANEL_CTE + PREDS_CTE + """
SELECT CAST(date_trunc('month', ds) AS DATE) AS month, ROUND(AVG(CAST(y AS DOUBLE)), 4) AS actual_mean,
       ROUND(AVG(CAST(pred_lag1 AS DOUBLE)), 4) AS pred_lag1_mean, ROUND(AVG(CAST(pred_lag12 AS DOUBLE)), 4) AS pred_lag12_mean
FROM pr WHERE pred_lag12 IS NOT NULL GROUP BY 1"""),
}
