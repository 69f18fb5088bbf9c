"""Registered model queries: decomposition, boosted trees, legacy regressions, tuning, registry,
ensemble. Model fits have no SQL equivalent, so most are rows-only; the ensemble of the two SQL
forecasters keeps a DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import boosting, decompose, legacy, linear, trees, tuning
from ..operators import calendar, features as FT, metrics as MX
from ..session import cut_lineage, shared_path, written
from ..sources.tables import ledger
from . import series as SE
from .sqltext import ols_fitted_sql, ols_sql, with_ledger

# Month-day pairs of the holiday calendar used by the holiday-regressor query.
HOLIDAY_MONTH_DAYS = ((1, 1), (7, 4), (12, 25))
LEGACY_GROUPS = ["service_name", "segment", "region", "usage_family", "bu_code"]


def holidays_for(series: DataFrame, ds_col: str = "ds") -> DataFrame:
    """Holiday calendar over the years the series spans (plus the forecast years)."""
    yrs = series.agg(F.min(F.year(ds_col)).alias("a"), F.max(F.year(ds_col)).alias("b"))
    y = yrs.select(F.explode(F.sequence("a", F.col("b") + 3)).alias("y"))
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in HOLIDAY_MONTH_DAYS])
    return y.select("y", F.explode(md).alias("md")).select(F.make_date("y", "md.m", "md.d").alias("ds"), F.lit("holiday").alias("holiday"))


def q_decompose_forecast(spark: SparkSession, d: str) -> DataFrame:
    return decompose.forecast(SE.panel(spark, d), SE.PANEL, SE.H, "month")


def q_decompose_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return decompose.forecast(SE.panel(spark, d), SE.PANEL, SE.H, "month", {"seasonality_mode": "multiplicative"})


def q_decompose_daily_holidays(spark: SparkSession, d: str) -> DataFrame:
    s = SE.daily_bu(spark, d)
    return decompose.forecast(s, ["bu_code"], 90, "day", holidays=holidays_for(s))


def q_decompose_backtest(spark: SparkSession, d: str) -> DataFrame:
    return decompose.backtest_metrics(SE.daily_bu(spark, d), ["bu_code"], granularity="day")


def q_gbt_forecast(spark: SparkSession, d: str) -> DataFrame:
    fc, _ = trees.forecast(SE.panel(spark, d), SE.PANEL, "xgboost", SE.H)
    return fc


def q_gbt_validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, val = trees.fit(SE.panel(spark, d), SE.PANEL, "catboost")
    return trees.validation_metrics(val, SE.PANEL)


def q_month_year_regressor(spark: SparkSession, d: str) -> DataFrame:
    return MX.output_adapter(trees.month_year_regressor(SE.panel(spark, d), SE.PANEL, SE.H))


def _legacy_frame(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(legacy.monthly_groups(ledger(spark, d), LEGACY_GROUPS))  # fits pass over it some dozens of times


def q_tweedie_glm(spark: SparkSession, d: str) -> DataFrame:
    return legacy.evaluate(_legacy_frame(spark, d), LEGACY_GROUPS, "tweedie")


def q_tweedie_boosting(spark: SparkSession, d: str) -> DataFrame:
    """M4 with all categories, accounts included: boosted trees with Tweedie loss on target statistics, trained on
    the first 80 % of the months. Per later month the rows, and whether all predictions are above 0 and their sum
    is between half and twice the spend."""
    cats = [*LEGACY_GROUPS, "account_name"]
    frame = written(legacy.monthly_groups(ledger(spark, d).where("spend >= 0"), cats), "monthly-groups")
    train, _ = legacy.split_by_month(frame)
    last = train.agg(F.max("month")).first()[0]
    frame = frame.withColumn("__train", F.col("month") <= F.lit(last))
    rows = written(boosting.target_statistics(frame, cats, "spend", "month", 5.0, train="__train"), "boosting-rows")
    features = ["year", "month_num", *legacy.LAG_COLS, *legacy.ROLL, *[f"{c}__ts" for c in cats]]
    model = boosting.fit(rows.where("__train"), features, "spend", trees=100, depth=6, rate=0.1, min_weight=20.0, row_share=0.8, column_share=0.8)
    scored = boosting.predict(rows.where(~F.col("__train")), model)
    ratio = F.sum("prediction") / F.sum("spend")
    by = scored.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.coalesce((F.min("prediction") > 0) & ratio.between(0.5, 2.0), F.lit(False)).alias("ok"))
    return by.select("month", "rows", "ok")


def q_linear_onehot(spark: SparkSession, d: str) -> DataFrame:
    return legacy.evaluate(_legacy_frame(spark, d), LEGACY_GROUPS, "linear")


def q_flat_horizon_scoring(spark: SparkSession, d: str) -> DataFrame:
    return legacy.flat_horizon(_legacy_frame(spark, d), LEGACY_GROUPS, 24, "tweedie")


def q_tuned_forecast(spark: SparkSession, d: str) -> DataFrame:
    return tuning.tuned_forecast(SE.panel(spark, d), SE.PANEL)


def q_cv_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Depths of 3 and 6, all learning rates, shares and penalties of the full grid, at 4 numbers of trees."""
    grid = {**tuning.GRID, "maxDepth": [3, 6], "maxIter": [20, 50, 80, 100]}
    return tuning.grid_search_gbt(SE.panel(spark, d), SE.PANEL, grid)


def q_model_registry(spark: SparkSession, d: str) -> DataFrame:
    """Save six versions of the fitted legacy pipeline, keep the newest five, load the
    newest and score the test months with it."""
    frame = _legacy_frame(spark, d)
    train, test = legacy.split_by_month(frame)
    model = legacy.fit_regressor(train, LEGACY_GROUPS, "linear")
    reg, root = shared_path(spark, "model-registry"), shared_path(spark, "models")
    for seq in range(1, 7):
        tuning.save_model(spark, model, "linear_onehot", reg, root, seq)
    newest = tuning.load_newest(spark, reg, "linear_onehot")
    kept = tuning.registry_view(spark, reg).count()
    scored = newest.transform(legacy.prepare(legacy.map_unseen_levels(test, newest, LEGACY_GROUPS)))
    return scored.select(*LEGACY_GROUPS, "month", "spend", "prediction", F.lit(kept).alias("models_kept"))


def q_ensemble_forecast(spark: SparkSession, d: str) -> DataFrame:
    s = SE.panel(spark, d)
    m_ols = MX.error_metrics(linear.ols_fitted(s, SE.PANEL), SE.PANEL, "y", "yhat")
    m_sn = MX.error_metrics(FT.add_lags(s, SE.PANEL, ["ds"], "y", [12], prefix="pred_lag"), SE.PANEL, "y", "pred_lag12")
    return tuning.inverse_rmse_ensemble(
        {"ols": linear.ols_trend(s, SE.PANEL, SE.H), "snaive": linear.seasonal_naive(s, SE.PANEL, SE.H)},
        {"ols": m_ols, "snaive": m_sn},
        SE.PANEL,
    )


def q_level_forecast(spark: SparkSession, d: str) -> DataFrame:
    """P2 + A26: every forecast level (overall, each account, service, bu_code, segment) in one
    job: one grouping-sets aggregation, gap fill per (level, key), one trend fit per series."""
    from ..operators import profile as P

    lv = P.level_grouping_sets(ledger(spark, d)).select("level", "level_key", F.col("month").alias("ds"), F.col("spend").alias("y"))
    series = calendar.fill_gaps(lv, ["level", "level_key"], "month")
    return linear.ols_trend(series, ["level", "level_key"], 24)


def q_forecast_request(spark: SparkSession, d: str) -> DataFrame:
    """E3 / 3.2: the request flow (level + granularity + engine name), segment level, prophet role."""
    from .engine import run_forecast

    fc, _hist, kpis = run_forecast(ledger(spark, d), "segment", "monthly", "prophet", {"changepoint_prior_scale": 0.05})
    return fc.join(kpis, "segment")


def forecast_contract(spark: SparkSession, d: str, engine: str, **hyperparameters) -> DataFrame:
    """What every engine owes a request: the next 24 months of each series, once, with a forecast that
    is a number, not below 0 for tree engines, and a band that holds it where the engine gives one."""
    from .engine import run_forecast

    fc, _hist, _kpis = run_forecast(ledger(spark, d), "segment", "monthly", engine, hyperparameters or None)
    y = F.col("yhat").cast("double")
    ok = y.isNotNull() & ~F.isnan(y)
    if engine in ("xgboost", "catboost"):
        ok = ok & (y >= 0)
    if "yhat_lower" in fc.columns:
        ok = ok & (F.col("yhat_lower") <= y) & (y <= F.col("yhat_upper"))
    return fc.select("segment", F.col("ds").cast("date").alias("ds"), F.coalesce(ok, F.lit(False)).alias("ok"))


def q_contract_prophet(spark: SparkSession, d: str) -> DataFrame:
    return forecast_contract(spark, d, "prophet")


def q_contract_prophet_tuned(spark: SparkSession, d: str) -> DataFrame:
    return forecast_contract(spark, d, "prophet", tune=True)


def q_contract_linear(spark: SparkSession, d: str) -> DataFrame:
    return forecast_contract(spark, d, "linear")


def q_contract_catboost(spark: SparkSession, d: str) -> DataFrame:
    return forecast_contract(spark, d, "catboost")


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}

_E = "(CAST(y AS DECIMAL(20,2)) - CAST(p AS DECIMAL(20,2)))"


def _rmse_sql(src: str) -> str:
    from .sqltext import div_exact

    mse = div_exact(f"SUM({_E} * {_E})", "COUNT(*)", 6, 4, 38)
    return f"(SELECT segment, service_name, ROUND(sqrt(CAST({mse} AS DOUBLE)), 4) AS rmse FROM {src} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)"


CONTRACT = with_ledger("""
, s AS (SELECT segment, MAX(date_trunc('month', date)) AS m FROM ledger GROUP BY 1)
SELECT segment, CAST(m + to_months(CAST(h AS INTEGER)) AS DATE) AS ds, TRUE AS ok FROM s, range(1, 25) AS t(h)""")

ORACLE = {
    "contract_prophet": CONTRACT,
    "contract_prophet_tuned": CONTRACT,
    "contract_linear": CONTRACT,
    "contract_catboost": CONTRACT,
    "tweedie_boosting": with_ledger("""
, g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month,
               COUNT(DISTINCT (service_name, segment, region, usage_family, bu_code, account_name)) AS n FROM ledger WHERE spend >= 0 GROUP BY 1)
, c AS (SELECT month, n, SUM(n) OVER (ORDER BY month) AS cum, SUM(n) OVER () AS tot FROM g)
SELECT month, n AS rows, TRUE AS ok FROM c WHERE cum > tot * 0.8"""),
    "level_forecast": with_ledger(f"""
, b AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, account_name, service_name, CAST(bu_code AS VARCHAR) AS bu_code, segment, spend FROM ledger)
, g AS (SELECT month, account_name, service_name, bu_code, segment,
           GROUPING(account_name, service_name, bu_code, segment) AS gid, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend
        FROM b GROUP BY GROUPING SETS ((month), (month, account_name), (month, service_name), (month, bu_code), (month, segment)))
, lv AS (SELECT CASE gid WHEN 15 THEN 'overall' WHEN 7 THEN 'account_name' WHEN 11 THEN 'service_name' WHEN 13 THEN 'bu_code' ELSE 'segment' END AS level,
               CASE gid WHEN 7 THEN account_name WHEN 11 THEN service_name WHEN 13 THEN bu_code WHEN 14 THEN segment END AS level_key,
               month AS ds, spend AS y FROM g)
, bnd AS (SELECT level, level_key, MIN(ds) AS lo, MAX(ds) AS hi FROM lv GROUP BY 1, 2)
, sp AS (SELECT level, level_key, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ds FROM bnd)
, ser AS (SELECT sp.level, sp.level_key, sp.ds, CAST(COALESCE(lv.y, 0) AS DECIMAL(18,2)) AS y FROM sp LEFT JOIN lv
          ON sp.level = lv.level AND sp.level_key IS NOT DISTINCT FROM lv.level_key AND sp.ds = lv.ds)
""" + ols_sql("lf", "ser", ["level", "level_key"], 24) + """
SELECT * FROM lf"""),
    "ensemble_forecast": with_ledger(SE.PANEL_CTE + SE.OLS_CTE + SE.SNAIVE_CTE + SE.PREDS_CTE + f"""
""" + ols_fitted_sql("ofit", "ms", SE.PANEL) + f"""
, r1 AS {_rmse_sql('ofit')}
, r2 AS {_rmse_sql('(SELECT segment, service_name, y, pred_lag12 AS p FROM pr)')}
, j AS (SELECT o.segment, o.service_name, o.ds, CAST(o.yhat AS DOUBLE) AS ya, CAST(s.yhat AS DOUBLE) AS yb,
               CASE WHEN r1.rmse > 0 THEN 1.0 / CAST(r1.rmse AS DOUBLE) ELSE 0.0 END AS wa,
               CASE WHEN r2.rmse > 0 THEN 1.0 / CAST(r2.rmse AS DOUBLE) ELSE 0.0 END AS wb
        FROM ols o JOIN r1 USING (segment, service_name) JOIN snaive s USING (segment, service_name, ds) JOIN r2 USING (segment, service_name))
SELECT segment, service_name, ds, ROUND(CASE WHEN wa + wb > 0 THEN (wa * ya + wb * yb) / (wa + wb) END, 2) AS yhat,
       ROUND(wa / (wa + wb), 6) AS weight_ols, ROUND(wb / (wa + wb), 6) AS weight_snaive
FROM j"""),
}
