"""M1: decomposable trend + seasonality forecaster, fitted per series with ``applyInPandas``.

Model (the published additive time-series design): y(t) = g(t) + s(t) + h(t) + e, with a
piecewise-linear trend g (slope changes at ``n_changepoints`` evenly spaced points in the first
80% of the history), Fourier seasonality s (yearly, plus weekly for daily data) and optional
holiday flags h. The fit is MAP: changepoint deltas have a Laplace prior of scale
``changepoint_prior_scale``, which leaves most of them at zero, seasonal terms a Gaussian one of
scale ``seasonality_prior_scale``, and the noise variance is estimated with them. It is solved on the
normal equations by an active-set search over the deltas, so its cost hardly depends on the history's
length. ``multiplicative`` fits on the log scale, so seasonality scales with the trend.
The band (80% by default) comes from simulated futures: the trend goes on changing its slope as often
and as much as it did in the history, so the band widens with the horizon.

Scale: Spark shuffles rows by series key and runs one small fit per series in a Python worker,
Arrow-batched. A series here is a resampled calendar (at most one row per period), so a group
holds at most a few thousand rows however hot the key is; no data passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..operators.calendar import attach_holidays

# Defaults of the decomposition model.
DEFAULTS = {
    "changepoint_prior_scale": 0.05,
    "seasonality_prior_scale": 10.0,
    "seasonality_mode": "additive",
    "n_changepoints": 25,
    "changepoint_range": 0.8,
    "interval_width": 0.8,
    "yearly_order": 10,
    "weekly_order": 3,
}


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    cols = []
    for k in range(1, order + 1):
        a = 2.0 * np.pi * k * days / period
        cols += [np.sin(a), np.cos(a)]
    return np.column_stack(cols) if cols else np.zeros((len(days), 0))


def solve(G: np.ndarray, c: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The minimum of ``b'Gb/2 - c'b + ridge'b^2/2 + lasso'|b|``, from ``start`` on.

    An active-set search: with the signs of the terms in use held, the problem is linear. Its solution is
    approached up to the best point where a sign would change; the unused term with the steepest slope
    beyond its threshold comes in next. Each step lowers the objective, so it ends.
    """
    A = G + np.diag(ridge)
    free = lasso == 0
    b = np.zeros(len(c)) if start is None else start.copy()
    slack = 1e-9 * max(np.abs(c).max(), 1e-12) + 1e-7 * lasso

    def cost(x: np.ndarray) -> float:
        return float(x @ (A @ x) / 2 - c @ x + lasso @ np.abs(x))

    def linear(use: np.ndarray, sign: np.ndarray) -> np.ndarray:
        x = np.zeros(len(c))
        at = np.flatnonzero(use)
        part, right = A[np.ix_(at, at)], c[at] - lasso[at] * sign[at]
        try:
            x[at] = np.linalg.solve(part, right)
        except np.linalg.LinAlgError:
            x[at] = np.linalg.lstsq(part, right, rcond=None)[0]
        return x

    sign = np.sign(b)
    now = cost(b)
    for _ in range(20 * len(c)):
        use = free | (sign != 0)
        x = linear(use, sign)
        turned = use & ~free & (np.sign(x) != sign)
        if turned.any():
            # points on the way where a term reaches zero, and the end
            with np.errstate(divide="ignore", invalid="ignore"):
                t = b / (b - x)
            stops = np.unique(np.r_[t[turned & (b != 0)], 1.0])
            stops = stops[(stops > 0) & (stops <= 1)]
            best = min(((cost(b + s * (x - b)), s) for s in stops), default=(now, 0.0))
            nxt = b + best[1] * (x - b)
            nxt[~free & (np.abs(t - best[1]) < 1e-12)] = 0.0
            nxt[~use] = 0.0
            if best[0] >= now - 1e-15 * max(abs(now), 1e-300):
                # nothing gained on this way: terms that would turn at once leave
                nxt = b.copy()
                gone = turned & (b == 0)
                if not gone.any():
                    break
                sign[gone] = 0
                continue
            b, now, sign = nxt, best[0], np.where(free, 0, np.sign(nxt))
            continue
        b, now = x, cost(x)
        slope = A @ b - c
        over = np.where(~free & (b == 0), np.abs(slope) - lasso - slack, -1.0)
        i = int(over.argmax())
        if over[i] <= 0:
            break
        sign[i] = -np.sign(slope[i])
    return b


def simulate(p: dict, deltas: np.ndarray, sd: float, ahead: np.ndarray, paths: int = 400, seed: int = 7) -> np.ndarray:
    """Deviations from the forecast, ``(paths, len(ahead))``: noise, and slope changes after the history as
    frequent and as large as the fitted ones. ``ahead`` is scaled time after the last point, ascending."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0.0, sd, (paths, len(ahead)))
    size = float(np.abs(deltas).mean()) if len(deltas) else 0.0
    if size > 0:
        rate = len(deltas) / p["changepoint_range"]  # per length of the history
        step = np.diff(np.r_[0.0, np.maximum(ahead, 0.0)])
        changes = rng.poisson(rate * step, (paths, len(ahead)))
        # the sum of k Laplace changes, each within its step: half a step of it acts there
        slope = rng.laplace(0.0, size, (paths, len(ahead))) * np.sqrt(changes)
        out += np.cumsum((np.cumsum(slope, axis=1) - slope / 2) * step, axis=1)
    return out


def _design(days: np.ndarray, t0: float, span: float, cps: np.ndarray, daily: bool, p: dict, holiday: np.ndarray | None):
    t = (days - t0) / span
    blocks = [np.ones_like(t)[:, None], t[:, None]]
    pen, lasso = [0.0, 0.0], [0.0, 0.0]
    if len(cps):
        blocks.append(np.maximum(t[:, None] - cps[None, :], 0.0))
        pen += [0.0] * len(cps)
        lasso += [1.0 / p["changepoint_prior_scale"]] * len(cps)
    yo = p["yearly_order"]
    yr = _fourier(days, 365.25, yo)
    blocks.append(yr)
    pen += [1.0 / p["seasonality_prior_scale"] ** 2] * yr.shape[1]
    if daily:
        wk = _fourier(days, 7.0, p["weekly_order"])
        blocks.append(wk)
        pen += [1.0 / p["seasonality_prior_scale"] ** 2] * wk.shape[1]
    if holiday is not None:
        blocks.append(holiday[:, None])
        pen.append(1.0 / p["seasonality_prior_scale"] ** 2)
    return np.hstack(blocks), np.asarray(pen), np.asarray(lasso + [0.0] * (len(pen) - len(lasso)))


def fit_predict(hist: pd.DataFrame, future_days: np.ndarray, params: dict, daily: bool, fut_holiday: np.ndarray | None = None):
    """Fit on ``hist`` (columns ds, y[, is_holiday]) and predict at ``future_days`` (days since
    epoch). Returns (yhat, lower, upper) arrays. Plain numpy; used inside grouped-map workers."""
    p = settings(params, daily)
    days = (pd.to_datetime(hist["ds"]).values.astype("datetime64[D]").astype(np.int64)).astype(float)
    y = hist["y"].astype(float).to_numpy()
    mult = p["seasonality_mode"] == "multiplicative"
    if mult:  # credits are negative, so the sign stays outside the logarithm
        y = np.sign(y) * np.log1p(np.abs(y))
    scale = float(np.max(np.abs(y))) or 1.0
    ys = y / scale
    t0, span = float(days.min()), float(max(days.max() - days.min(), 1.0))
    n_cp = int(min(p["n_changepoints"], max(len(days) - 2, 0)))
    cps = np.linspace(0, p["changepoint_range"], n_cp + 1)[1:] if n_cp > 0 else np.array([])
    hol = hist["is_holiday"].astype(float).to_numpy() if "is_holiday" in hist else None
    X, pen, lasso = _design(days, t0, span, cps, daily, p, hol)
    G, c = X.T @ X, X.T @ ys
    var = max(float(np.var(ys)), 1e-8) / 4
    beta = None
    for _ in range(4):  # the priors weigh as much as the noise is large
        beta = solve(G, c, var * pen, var * lasso, beta)
        var = max(float(np.mean((ys - X @ beta) ** 2)), 1e-10)
    resid_sd = float(np.std(ys - X @ beta, ddof=min(1, max(len(ys) - 1, 0)))) if len(ys) > 1 else 0.0
    fh = fut_holiday if hol is not None else None
    if hol is not None and fh is None:
        fh = np.zeros(len(future_days))
    Xf, _, _ = _design(future_days.astype(float), t0, span, cps, daily, p, fh)
    mid = Xf @ beta
    ahead = (future_days.astype(float) - days.max()) / span
    order = np.argsort(ahead, kind="stable")
    away = np.empty((400, len(ahead)))
    away[:, order] = simulate(p, beta[2 : 2 + len(cps)], resid_sd, ahead[order])
    low, high = np.quantile(away, [0.5 - p["interval_width"] / 2, 0.5 + p["interval_width"] / 2], axis=0) if len(ahead) else (mid, mid)
    lo, hi = mid + np.minimum(low, 0.0), mid + np.maximum(high, 0.0)
    out = [v * scale for v in (mid, lo, hi)]
    if mult:
        out = [np.sign(v) * np.expm1(np.abs(v)) for v in out]
    return out


def _step_days(granularity: str) -> bool:
    return granularity.lower() in ("day", "daily", "d")


# Pandas offsets of the granularities; a period starts on its first day, a week on Monday.
STEPS = {"d": "D", "day": "D", "daily": "D", "w": "W-MON", "week": "W-MON", "weekly": "W-MON", "m": "MS", "ms": "MS", "month": "MS", "monthly": "MS", "y": "YS", "year": "YS", "yearly": "YS"}


def future_dates(last: pd.Timestamp, horizon: int, granularity: str) -> pd.DatetimeIndex:
    """The ``horizon`` period starts after ``last``; an unknown granularity is an error."""
    step = STEPS.get(granularity.lower())
    if step is None:
        raise ValueError(f"unknown granularity {granularity!r}")
    return pd.date_range(last + pd.Timedelta(days=1), periods=horizon, freq=step)


def settings(params: dict, daily: bool) -> dict:
    """Defaults and ``params`` together; unknown names and impossible widths are errors. Unless it is
    given, the yearly order is what the step can tell apart."""
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    given = {k: v for k, v in params.items() if v is not None}
    p = {**DEFAULTS, **given}
    if "yearly_order" not in given and not daily:
        p["yearly_order"] = min(p["yearly_order"], 5)
    if not 0 < p["interval_width"] < 1:
        raise ValueError("interval_width lies between 0 and 1")
    return p


#: What a series' own parameters may be: columns of the table that ``forecast`` and ``backtest`` take.
TUNED = ("changepoint_prior_scale", "seasonality_mode", "seasonality_prior_scale")


def _source(series: DataFrame, keys: Sequence[str], ds_col: str, value: str, holidays: DataFrame | None, per_series: DataFrame | None) -> DataFrame:
    """(keys, ds, y[, is_holiday][, parameters, trial]) of every series."""
    src = series.select(*keys, F.col(ds_col).alias("ds"), F.col(value).cast("double").alias("y"))
    if holidays is not None:
        src = attach_holidays(src, holidays, "ds")
    if per_series is not None:
        src = null_safe_join(src, per_series.select(*keys, *TUNED, "trial"), keys)
    return src


def holiday_days(holidays: DataFrame | None) -> set[int] | None:
    """Day numbers of a holiday calendar, which is small by nature: days x names."""
    if holidays is None:
        return None
    from ..functions.sizing import require_at_most

    days = holidays.select("ds").distinct()
    require_at_most(days, 100_000, "holiday calendar")  # ~270 years of days
    return {r[0].toordinal() for r in days.collect()}


def _own(pdf: pd.DataFrame, params: dict) -> dict:
    """The parameters of this series: its own, where the table has them, in place of the common ones."""
    return {**params, **{k: pdf[k].iloc[0] for k in TUNED if k in pdf}}


def _key_types(series: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"{k} {series.schema[k].dataType.simpleString()}" for k in keys]


def forecast(
    series: DataFrame,
    keys: Sequence[str],
    horizon: int = 24,
    granularity: str = "month",
    params: dict | None = None,
    holidays: DataFrame | None = None,
    ds_col: str = "ds",
    value: str = "y",
    per_series: DataFrame | None = None,
) -> DataFrame:
    """Future rows only: ``keys, ds, yhat, yhat_lower, yhat_upper`` for H periods per series.

    ``per_series`` (keys, the columns TUNED, trial) gives each series its own parameters, which come before
    ``params``; the result then has its ``trial``.
    """
    params = dict(params or {})
    daily = _step_days(granularity)
    settings(params, daily)
    src = _source(series, keys, ds_col, value, holidays, per_series)
    last = ["trial"] if per_series is not None else []
    schema = ", ".join([*_key_types(series, keys), "ds date", "yhat double", "yhat_lower double", "yhat_upper double", *[f"{c} int" for c in last]])
    hol_days = holiday_days(holidays)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        fut = future_dates(pd.Timestamp(pdf["ds"].max()), horizon, granularity)
        fdays = fut.values.astype("datetime64[D]").astype(np.int64)
        fh = None
        if hol_days is not None:
            fh = np.array([1.0 if d.toordinal() in hol_days else 0.0 for d in fut])
        yhat, lo, hi = fit_predict(pdf, fdays, _own(pdf, params), daily, fh)
        out = pd.DataFrame({"ds": fut.date, "yhat": yhat, "yhat_lower": lo, "yhat_upper": hi})
        for k in [*keys, *last]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "ds", "yhat", "yhat_lower", "yhat_upper", *last]]

    return src.groupBy(*keys).applyInPandas(one, schema)


def backtest(
    series: DataFrame,
    keys: Sequence[str],
    initial_days: int = 180,
    period_days: int = 30,
    horizon_days: int = 90,
    granularity: str = "day",
    params: dict | None = None,
    ds_col: str = "ds",
    value: str = "y",
    holidays: DataFrame | None = None,
    per_series: DataFrame | None = None,
) -> DataFrame:
    """Rolling-origin evaluation. A cutoff's model is fitted on the rows up to it and predicts the next
    ``horizon_days``; cutoffs step back from the series' end by ``period_days`` while ``initial_days`` of
    history are left (``features.backtest_cutoffs``). A series goes to its task once, sorted, and every
    cutoff is a slice of it there: no row is copied per cutoff. Holidays and a series' own parameters are
    those of ``forecast``. Returns test rows ``keys, cutoff, ds, y, yhat``; aggregate with ``error_metrics``."""
    params = dict(params or {})
    daily = _step_days(granularity)
    settings(params, daily)
    src = _source(series, keys, ds_col, value, holidays, per_series)
    schema = ", ".join([*_key_types(series, keys), "cutoff date", "ds date", "y double", "yhat double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds", ignore_index=True)
        days = pd.to_datetime(pdf["ds"]).values.astype("datetime64[D]").astype(np.int64)
        own, parts = _own(pdf, params), []
        cutoffs = np.arange(days[-1] - horizon_days, days[0] + initial_days - 1, -period_days)
        for cut in cutoffs:
            a, b = np.searchsorted(days, [cut, cut + horizon_days], "right")
            if a < 2 or a == b:
                continue
            train, test = pdf.iloc[:a], pdf.iloc[a:b]
            flags = test["is_holiday"].astype(float).to_numpy() if "is_holiday" in test else None
            yhat, _, _ = fit_predict(train, days[a:b], own, daily, flags)
            out = test[[*keys, "ds", "y"]].copy()
            out["cutoff"], out["yhat"] = np.datetime64(int(cut), "D").astype(object), yhat
            parts.append(out[[*keys, "cutoff", "ds", "y", "yhat"]])
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*keys, "cutoff", "ds", "y", "yhat"])

    return src.where("ds is not null").groupBy(*keys).applyInPandas(one, schema)


def backtest_metrics(series: DataFrame, keys: Sequence[str], granularity: str = "day", params: dict | None = None, **kw) -> DataFrame:
    """W11 + A18 per series, keeping series that could not be backtested: their metrics are NULL
    with a ``reason`` (a failed backtest must not read as a perfect score)."""
    from ..operators.metrics import error_metrics

    bt = backtest(series, keys, granularity=granularity, params=params, **kw)
    m = error_metrics(bt, keys, "y", "yhat")
    everyone = series.select(*keys).distinct()
    return null_safe_join(everyone, m, keys, "left").withColumn(
        "reason", F.when(F.col("n").isNull(), F.lit("insufficient history for a backtest"))
    )
