"""Forecast evaluation and reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.money import mean_money, safe_ratio

# Reporting constants.
DAYS_PER_MONTH = 30.44  # average monthly spend from a daily forecast
BUDGET_FACTOR = 1.2  # dashboard budget = 1.2 x forecast total
GAUGE_SEGMENTS = 8
BAND = 0.1  # +-10% band when a model gives none


def error_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat", digits: int = 4) -> DataFrame:
    """Rmse, mse, mae, mape (a fraction), r2 per series, as one SQL aggregation.

    When actual and prediction are both DECIMAL (money), the squared and absolute errors are
    summed exactly and mse / mae are DECIMAL(38,6), so the metric does not depend on the order
    rows arrive in; rmse is the square root of that exact mse. Otherwise the errors are doubles.
    r2 = 1 - sse / sst with sst = n * var_pop(y), computed in the same pass. MAPE is averaged over
    periods with a non-zero actual (null if there are none): a zero actual (an empty, gap-filled
    period) has no percentage error, and flooring the denominator at machine epsilon would let a
    single such period dominate the mean with a ~1e16 term.
    """
    types = dict(df.dtypes)
    exact = types[y].startswith("decimal") and types[yhat].startswith("decimal")
    a_d, p_d = F.col(y).cast("double"), F.col(yhat).cast("double")
    if exact:
        e = F.col(y).cast("decimal(20,2)") - F.col(yhat).cast("decimal(20,2)")
    else:
        e = a_d - p_d
    agg = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("__sse"),
        F.sum(F.abs(e)).alias("__sae"),
        F.avg(F.when(a_d != 0, F.abs(a_d - p_d) / F.abs(a_d))).alias("mape"),
        F.var_pop(a_d).alias("__var"),
    )
    if exact:
        mse = F.round(F.col("__sse") / F.col("n"), 6).cast("decimal(38,6)")
        mae = F.round(F.col("__sae") / F.col("n"), 6).cast("decimal(38,6)")
    else:
        mse = F.round(F.col("__sse") / F.col("n"), digits)
        mae = F.round(F.col("__sae") / F.col("n"), digits)
    r2 = F.when(F.col("__var") > 0, F.lit(1.0) - F.col("__sse").cast("double") / (F.col("__var") * F.col("n")))
    return agg.select(*keys, "n", mse.alias("mse"), mae.alias("mae"), F.round("mape", 6).alias("mape"), F.round(r2, 6).alias("r2")).withColumn(
        "rmse", F.round(F.sqrt(F.col("mse").cast("double")), digits)
    )


def forecast_kpis(forecast: DataFrame, keys: Sequence[str], yhat: str = "yhat", daily: bool = False) -> DataFrame:
    """Total forecast, average monthly forecast (x 30.44 for daily), period count; money in
    exact DECIMAL (the mean is ``sum * factor / count`` rounded half-up to cents)."""
    y = F.col(yhat).cast("decimal(18,2)")
    factor = F.lit(DAYS_PER_MONTH if daily else 1).cast("decimal(6,2)")
    return forecast.groupBy(*keys).agg(
        F.sum(y).cast("decimal(18,2)").alias("total_forecasted_spend"),
        (F.sum(y) * factor / F.count(y)).cast("decimal(18,2)").alias("average_monthly_spend"),
        F.count(F.lit(1)).alias("forecast_period"),
    )


def dashboard_kpis(kpis: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """budget = 1.2 x total, spend share of budget, accuracy = max(0, 100 - 100 mape),
    8-segment gauges by floor. Without a MAPE the accuracy is null, not 100%."""
    j = null_safe_join(kpis, metrics.select(*keys, "mape"), keys, "left")
    total = F.coalesce(F.col("total_forecasted_spend").cast("double"), F.lit(0.0))
    budget = total * F.lit(BUDGET_FACTOR)
    pct = F.when(budget > 0, total / budget * 100).otherwise(F.lit(0.0))
    acc = F.when(F.col("mape").isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - F.col("mape") * 100))
    return j.select(
        *keys,
        F.round(budget, 2).alias("budget"),
        F.round(pct, 4).alias("spend_pct"),
        F.floor(pct / 100 * GAUGE_SEGMENTS).cast("int").alias("spend_segments"),
        F.round(acc, 4).alias("accuracy_pct"),
        F.floor(acc / 100 * GAUGE_SEGMENTS).cast("int").alias("accuracy_segments"),
    )


def model_comparison(metrics_a: DataFrame, metrics_b: DataFrame, keys: Sequence[str], name_a: str = "model_a", name_b: str = "model_b") -> DataFrame:
    """Per series and metric, the winner: lower rmse / mae, higher r2; ties go to the second
    model. Metrics are stacked with ``stack`` (no join per metric)."""
    j = null_safe_join(
        metrics_a.select(*keys, *[F.col(m).cast("double").alias(f"a_{m}") for m in ("rmse", "mae", "r2")]),
        metrics_b.select(*keys, *[F.col(m).cast("double").alias(f"b_{m}") for m in ("rmse", "mae", "r2")]),
        keys,
    )
    long = j.select(
        *keys,
        F.expr("stack(3, 'rmse', a_rmse, b_rmse, 'mae', a_mae, b_mae, 'r2', a_r2, b_r2) AS (metric, value_a, value_b)"),
    )
    a_wins = F.when(F.col("metric") == "r2", F.col("value_a") > F.col("value_b")).otherwise(F.col("value_a") < F.col("value_b"))
    return long.withColumn("winner", F.when(a_wins, F.lit(name_a)).otherwise(F.lit(name_b)))


def forecast_difference(fa: DataFrame, fb: DataFrame, keys: Sequence[str], ds_col: str = "ds", yhat: str = "yhat") -> DataFrame:
    """Per period difference and percent difference against the second model (0 if its
    forecast is 0)."""
    j = null_safe_join(
        fa.select(*keys, ds_col, F.col(yhat).cast("double").alias("yhat_a")),
        fb.select(*keys, ds_col, F.col(yhat).cast("double").alias("yhat_b")),
        [*keys, ds_col],
    )
    diff = F.col("yhat_a") - F.col("yhat_b")
    return j.select(*keys, ds_col, "yhat_a", "yhat_b", F.round(diff, 4).alias("diff"), F.round(safe_ratio(diff * 100, F.col("yhat_b")), 4).alias("pct_diff"))


def forecast_difference_summary(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A22 summary per series: each model's mean and range, mean difference and mean percent
    difference (periods where the second model forecasts 0 have no percent difference)."""
    pct = F.try_divide(F.col("yhat_a") - F.col("yhat_b"), F.nullif(F.col("yhat_b"), F.lit(0.0))) * 100
    a, b = F.col("yhat_a").cast("decimal(18,2)"), F.col("yhat_b").cast("decimal(18,2)")
    return diff.groupBy(*keys).agg(
        mean_money(a).alias("avg_a"),
        mean_money(b).alias("avg_b"),
        mean_money(a - b).alias("avg_diff"),
        F.round(F.avg(pct), 4).alias("avg_pct_diff"),
        F.min("yhat_a").alias("min_a"), F.max("yhat_a").alias("max_a"),
        F.min("yhat_b").alias("min_b"), F.max("yhat_b").alias("max_b"),
    )


def variance_facts(history: DataFrame, forecast: DataFrame, keys: Sequence[str], ds_col: str = "ds", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Forecast total minus historical total, with the increase / decrease wording and the
    period counts (distinct historical months, forecast periods)."""
    h = history.groupBy(*keys).agg(F.sum(y).cast("decimal(18,2)").alias("historical_total"), F.countDistinct(F.trunc(ds_col, "month")).alias("historical_months"))
    f = forecast.groupBy(*keys).agg(F.sum(F.col(yhat).cast("decimal(18,2)")).cast("decimal(18,2)").alias("forecast_total"), F.count(F.lit(1)).alias("forecast_periods"))
    j = null_safe_join(h, f, keys)
    var = (F.col("forecast_total") - F.col("historical_total")).cast("decimal(18,2)")
    word = F.when(var > 0, F.lit("an increase of $")).otherwise(F.lit("a decrease of $"))
    return j.select(*keys, "historical_total", "forecast_total", var.alias("variance"), F.concat(word, F.format_number(F.abs(var), 2)).alias("trend"), "historical_months", "forecast_periods")


def output_adapter(df: DataFrame) -> DataFrame:
    """P10: first of ds / date / Month -> ds, yhat / forecast -> yhat, y / spend / Cost -> y;
    missing bounds become yhat x 0.9 / x 1.1 (0 when yhat is 0 or null)."""
    cols = df.columns

    def first(*names) -> Column | None:
        present = [F.col(n) for n in names if n in cols]
        return F.coalesce(*present) if len(present) > 1 else (present[0] if present else None)

    out = {}
    ds = first("ds", "date", "Month")
    if ds is not None:
        out["ds"] = ds
    yh = first("yhat", "forecast")
    if yh is not None:
        out["yhat"] = yh
        truthy = F.coalesce(yh.cast("double"), F.lit(0.0)) != 0
        out["yhat_lower"] = F.col("yhat_lower") if "yhat_lower" in cols else F.when(truthy, yh.cast("double") * (1 - BAND)).otherwise(F.lit(0.0))
        out["yhat_upper"] = F.col("yhat_upper") if "yhat_upper" in cols else F.when(truthy, yh.cast("double") * (1 + BAND)).otherwise(F.lit(0.0))
    yv = first("y", "spend", "Cost")
    if yv is not None:
        out["y"] = F.coalesce(yv, F.lit(0))
    keep = [c for c in cols if c not in {"ds", "date", "Month", "yhat", "forecast", "y", "spend", "Cost", "yhat_lower", "yhat_upper"}]
    return df.select(*keep, *[v.alias(k) for k, v in out.items()])


def align_history_forecast(history: DataFrame, forecast: DataFrame, keys: Sequence[str], ds_col: str = "ds") -> DataFrame:
    """History and forecast on one time axis (full outer join on series + period).

    Rows with a null period or a falsy forecast are skipped on the forecast side; where both
    exist the prediction attaches to the actual point without a band; forecast-only points carry
    the band when the lower bound is truthy.
    """
    h = history.where(F.col(ds_col).isNotNull()).select(*keys, ds_col, F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("actual"), F.lit(True).alias("__h"))
    f = forecast.where(F.col(ds_col).isNotNull() & (F.coalesce(F.col("yhat").cast("double"), F.lit(0.0)) != 0)).select(
        *keys, ds_col, F.col("yhat").cast("double").alias("predicted"), F.col("yhat_lower").cast("double").alias("lo"), F.col("yhat_upper").cast("double").alias("hi")
    )
    j = null_safe_join(h, f, [*keys, ds_col], "full_outer")
    band = F.col("__h").isNull() & (F.coalesce(F.col("lo"), F.lit(0.0)) != 0)
    return j.select(
        *keys, ds_col, "actual", "predicted",
        F.when(band, F.col("lo")).alias("band_lower"),
        F.when(band, F.col("hi")).alias("band_upper"),
    )


def actual_vs_predicted_monthly(df: DataFrame, ds_col: str, y: str, preds: Sequence[str]) -> DataFrame:
    """Per month the mean actual and the mean of each model's prediction."""
    return df.groupBy(F.trunc(ds_col, "month").alias("month")).agg(
        F.round(F.avg(F.col(y).cast("double")), 4).alias("actual_mean"),
        *[F.round(F.avg(F.col(p).cast("double")), 4).alias(f"{p}_mean") for p in preds],
    )
