"""The forecast request (P2, E3): level, granularity and model name -> forecast, history, metrics.

The reference serves one filtered series per request. Here a level is a grouping key, so one
call forecasts every account (or service, bu_code, segment) at once; filters still narrow the
ledger first (P1). Engines are looked up by name; an unknown name is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..models import decompose, linear, trees, tuning
from ..operators import calendar, metrics as MX
from ..operators.ledger import dimension_filter
from ..session import cut_lineage

# Forecast levels and the filter each one needs when a single series is requested.
LEVELS = {
    "overall_aggregate": [],
    "account": ["account_name"],
    "service": ["service_name"],
    "bu_code": ["bu_code"],
    "segment": ["segment"],
}
LEVEL_FILTER = {"account": "account_name", "service": "service_name", "bu_code": "bu_code", "segment": "segment_name"}
HORIZON = {"daily": 90, "weekly": 52, "monthly": 24, "yearly": 5}
STEP = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
# The accepted hyper-parameters per engine (one schema; anything else is an error).
PARAMS = {
    "prophet": {"changepoint_prior_scale", "seasonality_prior_scale", "seasonality_mode", "holidays", "tune", "trials"},
    "xgboost": {"maxIter", "stepSize", "maxDepth", "subsamplingRate", "refit"},
    "catboost": {"maxIter", "stepSize", "maxDepth", "subsamplingRate", "refit"},
    "linear": set(),
}


def validate_level(level: str, filters: dict, single_series: bool = False) -> list[str]:
    """The level's group keys. For a single-series request, account / service / segment need
    a truthy filter and bu_code a non-null one (0 is a valid code)."""
    if level not in LEVELS:
        raise ValueError(f"unknown forecast level {level!r}")
    if single_series and level in LEVEL_FILTER:
        v = filters.get(LEVEL_FILTER[level])
        if (level == "bu_code" and v is None) or (level != "bu_code" and not v):
            raise ValueError(f"{LEVEL_FILTER[level]} is required for a {level} forecast")
    return LEVELS[level]


def _prophet(series, keys, horizon, gran, hp):
    """Holidays and given parameters hold for the search, the fit and the backtest alike; a tuned request is
    backtested with each series' own best parameters."""
    hp = dict(hp)
    holidays = hp.pop("holidays", None)  # a table of days (ds)
    tune, trials = hp.pop("tune", False), hp.pop("trials", 20)
    best = None
    if tune:
        best = cut_lineage(tuning.tune_decompose(series, keys, trials, granularity=gran, params=hp, holidays=holidays))  # read twice
    fc = decompose.forecast(series, keys, horizon, gran, hp, holidays, per_series=best)
    return fc, decompose.backtest_metrics(series, keys, gran, hp, holidays=holidays, per_series=best)


def _trees(engine):
    def run(series, keys, horizon, gran, hp):
        hp = dict(hp)
        refit = bool(hp.pop("refit", False))
        fc, m = trees.forecast(series, keys, engine, horizon, gran, hp, refit=refit)
        return fc, m

    return run


def _linear(series, keys, horizon, gran, hp):
    return linear.ols_trend(series, keys, horizon, granularity=gran), None


ENGINES: dict[str, Callable] = {"prophet": _prophet, "xgboost": _trees("xgboost"), "catboost": _trees("catboost"), "linear": _linear}


def run_forecast(
    ledger: DataFrame,
    level: str = "overall_aggregate",
    granularity: str = "monthly",
    model_name: str = "prophet",
    hyperparameters: dict | None = None,
    single_series: bool = False,
    **filters,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S8 -> P1 / P2 -> A2 -> engine -> A19 (+ A18 where the engine validates).

    ``single_series`` is the request for one series: its level's filter is required. A filter that leaves
    no rows is an error. The default engine is backtested on every run; a series that is too short has
    null metrics and a ``reason``. With ``tune`` it is tuned first and run with the best parameters.

    Returns (forecast ``keys, ds, yhat[, yhat_lower, yhat_upper]``, history ``keys, ds, y``,
    metrics ``keys, total_forecasted_spend, average_monthly_spend, forecast_period[, rmse ...]``).
    """
    if model_name not in ENGINES:
        raise ValueError("Unsupported ML Model")
    if hyperparameters is not None and not isinstance(hyperparameters, dict):
        raise ValueError("hyperparameters must be a dict")
    unknown = set(hyperparameters or {}) - PARAMS[model_name]
    if unknown:
        raise ValueError(f"unknown hyperparameters for {model_name}: {sorted(unknown)}")
    keys = validate_level(level, filters, single_series)
    if granularity not in STEP:
        raise ValueError(f"unknown granularity {granularity!r}")
    gran = STEP[granularity]
    sliced = dimension_filter(ledger, **filters)
    if sliced.isEmpty():
        raise ValueError("no ledger rows match the request")
    # the overall series gets a constant key so every engine runs the same grouped plan
    run_keys = keys or ["series"]
    if not keys:
        sliced = sliced.withColumn("series", F.lit("overall"))
    history = calendar.resample(sliced, run_keys, gran)
    fc, err = ENGINES[model_name](history, run_keys, HORIZON[granularity], gran, dict(hyperparameters or {}))
    kpis = MX.forecast_kpis(fc, run_keys, daily=gran == "day")
    if err is not None:
        kpis = null_safe_join(kpis, err, run_keys, "left")
    return fc, history, kpis
